"""Operators for preparing texts and vectors for training, with their queries; nothing outside imports this."""
