"""Variant spellings of names (problem 7), by a pigeonhole segment join.

Values become bags of parts: case, accents, titles, legal forms and word order fall away, nicknames and set
abbreviations become their full words. Parts spelt differently are found by a segment join: every part is cut into k+1
segments, position-shifted substrings are looked up in an inverted index of the segments, and candidates are verified by
banded edit distance. A bag with one part respelt is linked to the bag it would then be; a bag with initials or cut
parts to the one entity whose parts they can be. Links are stars around the most frequent spelling, joined by pointers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrail.runtime import materialise

# Titles, words without meaning for identity, legal forms.
TITLES = "dr prof professor mr mrs ms miss mx sir dame hon".split()
FILLERS = "the of for and fur und der die das de du des la le les et del von".split()
LEGAL = "limited ltd corporation corp inc incorporated company co gmbh ag plc llc sa bv nv online".split()
# Words and their usual abbreviations.
ABBREVIATED = {
    "department": "dept dep", "institute": "inst instit", "university": "univ uni", "foundation": "fdn found fndn", "association": "assn assoc", "international": "intl int", "national": "natl nat", "government": "govt",
    "science": "sci", "sciences": "scis", "medicine": "med", "statistics": "stats stat", "research": "res", "centre": "center ctr", "laboratory": "lab", "technology": "tech", "engineering": "eng engg",
    "management": "mgmt", "development": "dev", "committee": "cttee", "council": "cncl", "group": "grp", "brothers": "bros",
}
# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex alec sandy sasha xander lex", "alexandra": "lexi sandra", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy cath",
    "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "dorothea": "thea dora dorothy dot", "edward": "ed eddie ted teddy ned", "elizabeth": "liz lizzie beth betty eliza lisa",
    "frances": "fanny", "francesca": "cesca fran franca chessie", "frederick": "fred freddy", "gerald": "gerry", "gregory": "greg", "henrietta": "etta hetty henny hattie", "henry": "harry hank", "james": "jim jimmy jamie",
    "jennifer": "jenny jen jenna", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "josie", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "lawrence": "larry",
    "leonard": "len lenny", "louisa": "lulu lou louise", "margaret": "peggy meg maggie madge greta", "matthew": "matt", "michael": "mike mick mickey micky", "nicholas": "nick nicky", "nikolaus": "klaus niko nik",
    "ottavio": "tavio tavi otto", "patricia": "patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "quentin": "quin quint", "raymond": "ray", "rebecca": "becky", "richard": "rick dick richie",
    "robert": "bob bobby rob robbie", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy sanna", "theodore": "theo", "thomas": "tom tommy", "timothy": "tim", "ulrike": "rike ulli uli",
    "victoria": "vicky vicki tori", "vincent": "vince", "virginia": "ginny", "walter": "walt", "william": "bill billy will willy liam", "zacharias": "zack zach zak", "yusuf": "yus", "ingrid": "inga", "renee": "nee",
}

_FULL = {a: w for table in (ABBREVIATED, NICKNAMES) for w, short in table.items() for a in short.split()}
_GIVEN = set(NICKNAMES)
_VOWELS = frozenset("aeiou")
_NUMBER = re.compile(r"\d")
_PARTS = re.compile(r"[^\W_]+")
_DOMAIN = re.compile(r"^(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:[a-z]{2,}\.)?[a-z]{2,}$")
_PHRASES = re.compile(r"\bmedia group\b")


def parts_of(value: str) -> tuple[list[str], bool, str]:
    """The parts of a name in order, whether it had a title, and its kind: name or site. Numbers are parts like others, but never respelt or cut."""
    s = unicodedata.normalize("NFKD", value).casefold()
    s = " ".join("".join(ch for ch in s if not unicodedata.combining(ch)).split())
    m = _DOMAIN.match(s)
    if m:
        return m[1].split("-"), False, "site"
    s = _PHRASES.sub(" ", s)
    s = re.sub(r"^u\.? of ", "university of ", s)
    s = re.sub(r"(?<=[a-z])'s\b", "", s)
    raw = _PARTS.findall(s)
    titled = any(t in TITLES for t in raw)
    kept = [t for t in raw if t not in TITLES and t not in FILLERS and t not in LEGAL]
    return [_FULL.get(t, t) for t in kept or raw], titled, "name"


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Starts and lengths of k+1 segments as even as can be, the longer ones last."""
    base, longer = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = base + (1 if i > k - longer else 0)
        out.append((at, n))
        at += n
    return out


def edit_distance(a: str, b: str, k: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, in a band of k on both sides of the diagonal; k+1 if more than k."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(k + 1, len(a) + len(b))
    far = k + 1
    older: list[int] = []
    old = [j if j <= k else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older[j - 2] + 1)
            new[j] = min(d, far)
        if min(new) > k:
            return far
        older, old = old, new
    return old[-1]


#: Longest strings whose deletion neighbourhoods are joined; segments of shorter ones would be met nearly everywhere.
SHORT = 7


def deletions(s: str, k: int) -> set[str]:
    """The string with up to k characters taken out."""
    out = {s}
    for _ in range(k):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def similar_strings(strings: DataFrame, k: int = 1, column: str = "s", min_length: int = 4) -> DataFrame:
    """a, b: every ordered pair of different strings at most k edits apart (swaps of neighbours count one), both at least min_length long.

    Segments are cut for 2k edits without swaps, which k with swaps never exceed, so no pair is lost: at least one segment
    of the shorter cut stands unchanged in the other string, shifted by at most k. Pairs with a string of SHORT characters
    or fewer are found by what is left of both when up to k characters are taken out. Null strings take no part; repeated
    strings count once.
    """
    cuts = 2 * k
    base = strings.select(F.col(column).alias("s")).where(F.length("s") >= min_length).distinct()
    long_, short = base.where(F.length("s") > SHORT), base.where(F.length("s") <= SHORT + k)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(len(s), i, s[p : p + n], s) for s in pdf["s"] for i, (p, n) in enumerate(segments(len(s), cuts))], columns=["n", "i", "seg", "b"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for s in pdf["s"]:
                for n in range(max(len(s) - k, SHORT + 1), len(s) + k + 1):
                    for i, (p, m) in enumerate(segments(n, cuts)):
                        for at in range(max(0, p - k), min(len(s) - m, p + k) + 1):
                            out.add((n, i, s[at : at + m], s))
            yield pd.DataFrame(list(out), columns=["n", "i", "seg", "a"])

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(x, s) for s in pdf["s"] for x in deletions(s, k)], columns=["left", "a"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[edit_distance(a, b, k) <= k for a, b in zip(pdf["a"], pdf["b"], strict=True)]]

    pairs = long_.mapInPandas(probe, "n int, i int, seg string, a string").join(long_.mapInPandas(index, "n int, i int, seg string, b string"), ["n", "i", "seg"]).select("a", "b")
    left = short.mapInPandas(shorten, "left string, a string")
    pairs = pairs.unionByName(left.join(left.withColumnRenamed("a", "b"), "left").select("a", "b"))
    return pairs.where("a <> b").distinct().mapInPandas(verify, "a string, b string")


def _root(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: links(node, to) lead each node to at most one other, always of higher rank; pointers are doubled until they rest."""
    state = materialise(nodes.join(links, "node", "left").select("node", F.coalesce("to", "node").alias("root")))
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialise(state.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        moved = new.join(state.withColumnRenamed("root", "was"), "node").where("root <> was")
        if moved.isEmpty():
            return new
        state = new


def consonants(word: str) -> str:
    """A word without the vowels after its first letter, as words are contracted."""
    return word[0] + "".join(ch for ch in word[1:] if ch not in _VOWELS)


def _cut_keys(parts: list[str]) -> set[str]:
    """Bags a full bag may be written as: one part as its initial, cut to three to five letters, or as its consonants."""
    out = set()
    for i, t in enumerate(parts):
        rest = parts[:i] + parts[i + 1 :]
        if not rest or _NUMBER.search(t):
            continue
        shorter = {t[:n] for n in (1, 3, 4, 5) if len(t) > n}
        bare = consonants(t)
        if 3 <= len(bare) < len(t):
            shorter.add(bare)
        out.update(" ".join(sorted([*rest, x])) for x in shorter)
    return out


def link_names(rows: DataFrame, column: str, kind: str | None = None, kinds: tuple[str, ...] = ("person", "organization"), k: int = 1) -> DataFrame:
    """value, entity: every different value of the column that is a name, exactly as stored, with the entity it spells.

    `kind` names a column that says what a row's name is, as typed and sometimes wrongly: an entity counts if most of its
    rows are of `kinds` (None: all count). Null, empty and blank values are no names. A part may be respelt by up to k
    edits, but no number is. A cut form that could be several entities stays alone. Repeated rows only weigh; ties go to the lesser spelling. An empty table
    gives no rows.
    """
    good = F.lit(1) if kind is None else F.coalesce(F.col(kind).isin(*kinds).cast("int"), F.lit(0))
    values = rows.where(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, n, g in zip(pdf["value"], pdf["n"], pdf["good"], strict=True):
                parts, titled, what = parts_of(v)
                if not parts:
                    continue
                long = [t for t in parts if len(t) > 1]
                # A middle initial says nothing where two full parts are there.
                if len(long) >= 2 and len(parts) > len(long) and (_GIVEN.intersection(long) or len(long) == 2 and parts[0] in long):
                    parts = long
                bag = " ".join(sorted(parts))
                out.append((v, n, g, bag, "".join(parts), titled or len(parts) == 1, what == "site"))
            yield pd.DataFrame(out, columns=["value", "n", "good", "bag", "joined", "alone", "site"])

    named = materialise(values.mapInPandas(parse, "value string, n long, good long, bag string, joined string, alone boolean, site boolean"))
    bags = materialise(named.where("not site").groupBy("bag").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    letters = materialise(named.where("not site").groupBy("joined", "bag").agg(F.sum("n").alias("n")))
    parts = bags.select("bag", F.explode(F.array_distinct(F.split("bag", " "))).alias("part"), "n")
    near = materialise(similar_strings(parts.select("part").where("part not rlike '[0-9]'"), k, "part"))

    # One part respelt: the bag it would be, if there is one and it is more frequent. Bags with cut parts count as well.
    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf["bag"]:
                words = b.split(" ")
                if len(words) >= 2 and all(len(w) > 1 for w in words):
                    out.extend((b, c) for c in _cut_keys(words))
                    if len(words) == 2 and _GIVEN.intersection(words) or len(words) == 2 and kind is not None:
                        out.extend((b, w) for w in words if w not in _GIVEN)
            yield pd.DataFrame(out, columns=["full", "cut"])

    def respell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, a, t in zip(pdf["bag"], pdf["part"], pdf["b"], strict=True):
                words = b.split(" ")
                words[words.index(a)] = t
                out.append((b, " ".join(sorted(words))))
            yield pd.DataFrame(out, columns=["bag", "to"])

    respelt = materialise(parts.select("bag", "part").join(near.withColumnRenamed("a", "part"), "part").mapInPandas(respell, "bag string, to string").distinct())
    weight = bags.select(F.col("bag").alias("to"), F.col("n").alias("m"))
    order = Window.partitionBy("bag").orderBy(F.desc("m"), "to")
    typo = respelt.join(weight, "to").join(bags.select("bag", "n"), "bag").where("m > n or (m = n and to < bag)").withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("bag").alias("node"), "to")
    # The same letters with a space elsewhere.
    same = letters.groupBy("joined").agg(F.min_by("bag", F.struct(-F.col("n"), "bag")).alias("to"), F.count(F.lit(1)).alias("k")).where("k > 1")
    spaced = letters.join(same, "joined").where("bag <> to").groupBy(F.col("bag").alias("node")).agg(F.max("to").alias("to"))
    first = typo.join(spaced.select("node"), "node", "left_anti").unionByName(spaced)
    # Two bags may point at each other by different rules: only upward in (n, bag) keeps pointers free of circles.
    rank = bags.select("bag", F.struct("n", F.col("bag")).alias("rank"))
    first = first.join(rank.select(F.col("bag").alias("node"), F.col("rank").alias("r1")), "node").join(rank.select(F.col("bag").alias("to"), F.col("rank").alias("r2")), "to").where("to <> node")
    up = first.where("r2.n > r1.n or (r2.n = r1.n and to < node)").groupBy("node").agg(F.max_by("to", "r2").alias("to"))
    nodes = bags.select(F.col("bag").alias("node"))
    roots = materialise(_root(up, nodes))

    # Cut forms: those that fit one entity alone, directly or with one part respelt.
    full = bags.select("bag").mapInPandas(cuts, "full string, cut string").join(roots.withColumnRenamed("node", "full"), "full").select("cut", "root").distinct()
    full = materialise(full)

    def shorter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf["bag"]:
                words = b.split(" ")
                ones = [w for w in words if len(w) == 1]
                out.append((b, b))
                # Of two initials either may be the given name's.
                if len(ones) >= 2:
                    for o in set(ones):
                        rest = [w for w in words if len(w) > 1]
                        out.append((b, " ".join(sorted([*rest, o]))))
            yield pd.DataFrame(out, columns=["bag", "key"])

    own_roots = roots.where("node = root").select(F.col("node").alias("bag"))
    # Every spelling gathered so far may be the one that is cut, for all of them; their most frequent one comes first.
    keys = nodes.select(F.col("node").alias("bag")).mapInPandas(shorter, "bag string, key string")
    keys = keys.join(roots.select(F.col("node").alias("bag"), F.col("root").alias("of")), "bag").select(F.col("of").alias("bag"), "key", (F.col("of") != F.col("bag")).cast("int").alias("edits"))
    exact = keys.join(full.withColumnRenamed("cut", "key"), "key").where("bag <> root").select("bag", "root", "edits")
    loose = respelt.join(own_roots, "bag", "left_semi").join(full.withColumnRenamed("cut", "to"), "to").where("bag <> root").select("bag", "root", F.lit(1).alias("edits"))
    fits = exact.unionByName(loose).groupBy("bag", "root").agg(F.min("edits").alias("edits"))
    best = fits.join(fits.groupBy("bag").agg(F.min("edits").alias("edits")), ["bag", "edits"]).groupBy("bag").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("to")).where("k = 1")
    total = materialise(named.where("not site").join(roots.withColumnRenamed("node", "bag"), "bag").groupBy("root").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    # A cut form leads to what it is cut from, never on to another cut form.
    second = best.select(F.col("bag").alias("node"), "to").join(best.select(F.col("bag").alias("to")), "to", "left_anti")
    entity = materialise(_root(second.select("node", "to"), own_roots.select(F.col("bag").alias("node"))))
    of_bag = materialise(roots.join(entity.select(F.col("node").alias("root"), F.col("root").alias("entity")), "root").select(F.col("node").alias("bag"), "entity"))
    # Site names have their parts run together, or joined by hyphens.
    joined = letters.join(of_bag, "bag").groupBy("joined").agg(F.max_by("entity", F.struct("n", "bag")).alias("entity"))
    plain = named.where("not site").join(of_bag, "bag").select("value", "n", "good", "entity")
    sites = named.where("site").join(joined, "joined", "left").select("value", "n", "good", F.coalesce("entity", F.concat(F.lit("site "), "joined")).alias("entity"))
    out = plain.unionByName(sites)
    ok = out.groupBy("entity").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).where("2 * good >= n").select("entity")
    return out.join(ok, "entity").select("value", "entity")


def name_pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: all pairs of different values of one entity, the lesser by code points first.

    The number of different spellings of one entity bounds its pairs; rows that repeat a spelling add none.
    """
    a = linked.select("entity", F.col("value").alias("name_a"))
    b = linked.select("entity", F.col("value").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
