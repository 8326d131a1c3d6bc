"""Variant spellings of names typed by people (problem 2).

Surnames, brands and given names are sharded into tries; Levenshtein automata walk them and list the neighbours within
one edit (a swap of neighbours counts as one). Names whose surnames are neighbours, in the order of tokens the corpus
suggests or turned round, are then compared part by part: given name, middle name, line of business. Full names are nodes,
joined into components; initials and bare brands are too weak to join others and are attached last, where just one
component fits.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm import mojibake
from docveil.llm.lookalikes import mapping
from docveil.operators.lineage import checkpointed
from docveil.sources.tables import table

#: Surnames and brands of fewer letters may differ by one edit only if one is much rarer; longer ones may anyway.
FUZZY_FROM = 5
#: Letters of the shortest word that gets neighbours at all: of a surname or brand, of a given name.
SHORTEST, SHORTEST_GIVEN = 2, 3
#: Index words, and words asked for, in one trie's walk, at most; a shard that holds more is split.
SHARD = 20_000
#: A given name or a short surname differing by one edit from another is its misspelling when it is this much rarer.
RARER = 0.05

# Titles, words of legal form, lines of business with their English names, short forms of given names.
TITLES = frozenset("av dr mr ms mrs sn sayin prof doc me maitre herr frau sig dott avv".split())
FORMS = frozenset(
    "a s as ltd sti san tic ve sanayi ticaret anonim limited sirketi sirket sti ltdsti inc co corp llp llc plc gmbh ag kg ohg mbh sarl sas sa srl spa r l p und and et "
    "holding holdings grup group partners handels associes servizi dis pazarlama".split()
)
BUSINESS = {
    "gida": "gida", "foods": "gida", "food": "gida", "kimya": "kimya", "chemicals": "kimya", "chemical": "kimya", "makine": "makine", "machinery": "makine", "tekstil": "tekstil", "textile": "tekstil",
    "textiles": "tekstil", "turizm": "turizm", "tourism": "turizm", "otomotiv": "otomotiv", "automotive": "otomotiv", "lojistik": "lojistik", "logistics": "lojistik", "elektronik": "elektronik",
    "electronics": "elektronik", "yazilim": "yazilim", "software": "yazilim", "enerji": "enerji", "energy": "enerji", "madencilik": "madencilik", "mining": "madencilik", "mobilya": "mobilya",
    "furniture": "mobilya", "ambalaj": "ambalaj", "packaging": "ambalaj", "yayincilik": "yayincilik", "publishing": "yayincilik", "danismanlik": "danismanlik", "consulting": "danismanlik",
    "consultancy": "danismanlik", "denizcilik": "denizcilik", "shipping": "denizcilik", "maritime": "denizcilik", "insaat": "insaat", "construction": "insaat", "saglik": "saglik", "health": "saglik",
    "healthcare": "saglik", "tarim": "tarim", "agriculture": "tarim", "sigorta": "sigorta", "insurance": "sigorta", "nakliyat": "nakliyat", "transport": "nakliyat", "egitim": "egitim", "education": "egitim",
}
SERVICES = frozenset(("hizmetleri", "hizm", "hiz", "services", "service"))
SHORT = {
    "apo": "abdullah", "abdo": "abdullah", "suko": "sukru", "memo": "mehmet", "memet": "mehmet", "gianni": "giovanni", "tom": "thomas", "sulo": "suleyman", "jen": "jennifer", "sandro": "alessandro",
    "ted": "edward", "ed": "edward", "eddie": "edward", "bob": "robert", "rob": "robert", "sam": "samuel", "wolf": "wolfgang", "dick": "richard", "rick": "richard", "dan": "daniel", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "renzo": "lorenzo", "bill": "william", "will": "william", "andy": "andrew", "alex": "alexander", "kate": "catherine", "cathy": "catherine", "becky": "rebecca",
    "vicky": "victoria", "charlie": "charlotte", "beth": "elizabeth", "liz": "elizabeth", "pat": "patrick", "ollie": "oliver", "jim": "james", "sue": "susan", "harry": "harriet", "theo": "theodore",
    "greg": "gregory", "fritz": "friedrich", "heinz": "heinrich", "hannes": "johannes", "lilo": "lieselotte", "lotte": "lieselotte", "andi": "andreas", "basti": "sebastian", "uschi": "ursula",
    "pippo": "filippo", "enzo": "vincenzo", "anni": "annegret", "kathi": "katharina", "matze": "matthias", "bea": "beatrice", "fran": "francesca", "gigi": "luigi", "titi": "thierry", "gerard": "gerard",
}

_MAPPED = {c: to for c, (to, _) in mapping().items()}
_TURKISH = str.maketrans({"ı": "i", "İ": "i", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe"})


@lru_cache(100_000)
def fold(text: str) -> str:
    """Lower case without accents; look-alikes, invisible characters and wrongly read bytes undone where certain."""
    if not text.isascii():
        if mojibake.STRANGE.search(text):
            text = text.translate(_MAPPED)
            sound = lambda r: all(c < "\x7f" or c in mojibake.NATURAL for c in r)
            if not sound(text):
                text = min((r for r, path in mojibake.readings(text) if sound(r) and len(r) <= len(text)), key=len, default=text)
        text = text.translate(_TURKISH)
        text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
        return text.translate(_TURKISH)
    return text.lower()


def aliases_of(raw: str | None) -> list[str]:
    """A JSON array of strings, or what looks like a list in plain text; anything else is no alias."""
    if not raw or not raw.strip():
        return []
    try:
        found = json.loads(raw)
        return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []
    except ValueError:
        return [x.strip().strip("[]\"'") for x in re.split(r"[;|]", raw) if x.strip().strip("[]\"'")]


def _company_tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[\s.,_&/()\-]+", fold(name)) if t]


def is_company(name: str) -> bool:
    tokens = _company_tokens(name)
    strong = [t for t in tokens if (t in FORMS and len(t) > 1) or t in BUSINESS]
    return bool(strong) or len(tokens) == 1 or bool(re.search(r"\ba\.?\s*s\.?\s*$", fold(name)))


def company(name: str) -> tuple[str, str]:
    """Brand and line of business (may be empty). A brand written in two words is one."""
    tokens = [t for t in _company_tokens(name) if t not in FORMS and t not in SERVICES and len(t) > 1]
    business, brand = "", []
    for i, t in enumerate(tokens):
        whole = BUSINESS.get(t)
        if not whole and len(tokens) > 1 and 2 <= len(t) <= 7 and (i > 0 or len(t) <= 4):
            fits = {b for w, b in BUSINESS.items() if w == b and w.startswith(t)}
            whole = fits.pop() if len(fits) == 1 else None
        if not whole and len(t) >= 5 and i > 0:
            whole = next((b for w, b in BUSINESS.items() if len(w) >= 5 and near(t, w)), None)
        if whole and not business:
            business = whole
        else:
            brand.append(t)
    return "".join(brand), business


def person(name: str) -> list[str]:
    """Parts of a name in the order given name to surname where a comma tells it; titles are dropped."""
    folded = fold(name).replace("_", " ")
    if folded.count(",") == 1:
        last, _, first = folded.partition(",")
        if first.strip() and last.strip():
            folded = f"{first} {last}"
    parts = [t.strip(".,;:'\"()") for t in re.split(r"\s+|(?<=[^\W\d_])\.(?=[^\W\d_])", folded)]
    return [t for t in parts if t and t not in TITLES and any(c.isalpha() for c in t)]


def near(a: str, b: str) -> bool:
    """Within one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


# --- the trie join -----------------------------------------------------------------------------------------------


class Trie:
    """Words as nested dictionaries; the key "" marks a word's end."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def neighbours(self, q: str) -> Iterator[str]:
        """All words within one edit of ``q``, by the automaton whose states are sets of positions with 0 or 1 edit.

        Bit i of a set: i letters of q are matched. ``swap`` holds positions whose next letter but one was read.
        """
        n = len(q)
        at: dict[str, int] = {}
        for i, c in enumerate(q):
            at[c] = at.get(c, 0) | 1 << i
        full, end = (1 << (n + 1)) - 1, 1 << n
        todo = [(self.root, 1, 0b11 & full, 0)]
        while todo:
            node, none, one, swap = todo.pop()
            for c, child in node.items():
                if c == "":
                    if (none | one) & end:
                        yield child
                    continue
                m = at.get(c, 0)
                none2 = (none & m) << 1
                one2 = ((one & m) << 1) | (none << 1) | none | (none2 << 1) | ((swap & m) << 2)
                one2 &= full
                if none2 | one2 or (none & (m >> 1)):
                    todo.append((child, none2, one2, none & (m >> 1)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard, its index words first: one trie is alive at a time."""
    shard, words, trie = None, [], None
    for batch in batches:
        out = []
        for key, asked, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != shard:
                shard, words, trie = key, [], None
            if not asked:
                words.append(word)
            elif words:
                # A few words are looked at one by one.
                if trie is None and len(words) > 4:
                    trie = Trie(words)
                out += [(word, w) for w in (trie.neighbours(word) if trie else (w for w in words if near(word, w)))]
        cols = list(zip(*out, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["q", "c"])


def _halves(size: Column) -> list[Column]:
    """Keys of ``word`` as one of an index word of ``size`` letters: its first half, its second half."""
    first = F.floor(size / 2).cast("int")
    mark = size.cast("string")
    return [F.concat(F.lit("^"), mark, F.lit(" "), F.left("word", first)), F.concat(F.lit("$"), mark, F.lit(" "), F.right("word", size - first))]


def _around() -> Column:
    """The key of a word without the two letters about its middle, which a swap of these leaves."""
    first = F.floor(F.length("word") / 2).cast("int")
    return F.concat(F.lit("~"), F.length("word").cast("string"), F.lit(" "), F.left("word", first - 1), F.substr("word", first + 2))


def trie_join(queries: DataFrame, index: DataFrame, shortest: int = SHORTEST + 1, shard: int = SHARD) -> DataFrame:
    """``q, c``: each query word (column ``word``) with the index words within one edit; of fewer than ``shortest``
    letters only if equal.

    One edit leaves one half of a word as it is, or is a swap of the two letters about its middle; so an index word is
    in the shards of its halves and of what surrounds its middle, and a query looks in those it may share with words one
    letter shorter, as long, and one longer. A shard of more than ``shard`` words is split, so a common ending is many
    tasks' work. Words are distinct, so a name borne by a third of all rows is one word."""
    q, c = queries.select("word").distinct(), index.select("word").distinct()
    equal = q.join(c, "word").select(F.col("word").alias("q"), F.col("word").alias("c"))
    size = F.length("word")
    indexed = c.where(size >= shortest).select("word", F.explode(F.array(*_halves(size), _around())).alias("shard"))
    other = [k for d in (-1, 0, 1) for k in _halves(size + d)]
    asked = q.where(size >= shortest - 1).select("word", F.explode(F.array_distinct(F.array(*other, _around()))).alias("shard"))
    held = indexed.groupBy("shard").agg(F.ceil(F.count("*") / shard).alias("parts"))
    # Shards without index words are no work.
    asked = asked.join(held, "shard")
    wide = asked.groupBy("shard").agg(F.ceil(F.count("*") / shard).alias("slices"))
    indexed = indexed.join(held, "shard").join(wide, "shard")
    asked = asked.join(wide, "shard")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    key = lambda a, b: F.concat_ws("/", "shard", a.cast("string"), b.cast("string")).alias("key")
    left = indexed.withColumn("slice", F.explode(spread("slices"))).select(key(own("parts"), F.col("slice")), F.lit(False).alias("asked"), "word")
    right = asked.withColumn("part", F.explode(spread("parts"))).select(key(F.col("part"), own("slices")), F.lit(True).alias("asked"), "word")
    found = left.unionByName(right).repartition("key").sortWithinPartitions("key", "asked").mapInArrow(_walk, "q string, c string")
    return equal.union(found).distinct()


# --- records and names -------------------------------------------------------------------------------------------

_NAMES = "rec long, client boolean, kind string, parts array<string>, brand string, business string"


def _parse(client: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, name, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = [x for x in ([name, *aliases_of(extra)] if client else [name]) if x and x.strip()]
                firm = any(map(is_company, names)) if client else extra == "company_name"
                for x in dict.fromkeys(names):
                    if firm:
                        brand, business = company(x)
                        if brand:
                            out.append((rec, client, "C", None, brand, business))
                    elif len(parts := person(x)) >= 2:
                        out.append((rec, client, "P", parts, None, None))
            cols = list(zip(*out, strict=True)) or [[] for _ in range(6)]
            kinds = [pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rec", "client", "kind", "parts", "brand", "business"])

    return run


def named_records(clients: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per record and name. Ids given twice count once; null and blank names are left out."""
    c = clients.select("id", "name", "aliases").dropDuplicates(["id"]).mapInArrow(_parse(True), _NAMES)
    f = findings.where("category in ('natural_person_name', 'company_name')").select("id", "sample", "category").dropDuplicates(["id"]).mapInArrow(_parse(False), _NAMES)
    return c.unionByName(f)


def nodes_of(names: DataFrame) -> DataFrame:
    """``rec, client, node, kind, word, given, middle, weak``: the surname or brand, and what else the name says.

    Which token is the surname is told by the corpus: a token met more often at the end of names than at the start.
    """
    people = names.where("kind = 'P'").withColumn("n", F.size("parts"))
    tokens = people.select(F.posexplode("parts").alias("i", "token"), "n").groupBy("token").agg(F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("first"), F.sum(F.when(F.col("i") == F.col("n") - 1, 1).otherwise(0)).alias("last"), F.count("*").alias("all"))
    ends = people.select("parts", "n").distinct().select("parts", F.col("parts")[0].alias("a"), F.element_at("parts", -1).alias("z"))
    at = lambda c: tokens.select(F.col("token").alias(c), "first", "last", (F.col("all") - F.col("last")).alias("before"))
    order = (
        ends.join(at("a").toDF("a", "a_first", "a_last", "a_before"), "a")
        .join(at("z").toDF("z", "z_first", "z_last", "z_before"), "z")
        .select("parts", ((F.col("a_last") >= F.col("a_first")) & (F.col("z_before") > F.col("z_last")) | (F.length("z") == 1)).alias("turned"))
    )
    p = people.join(order, "parts").select("rec", "client", "kind", F.when(F.col("turned"), _turned("parts")).otherwise(F.col("parts")).alias("t"))
    p = p.select("rec", "client", "kind", *_named("t"), F.struct(*_named(_turned("t"))).alias("turn"))
    p = p.withColumn("given", _full("given")).withColumn("turn", F.col("turn").withField("given", _full("turn.given"))).withColumn("weak", F.length("given") == 1)
    c = names.where("kind = 'C'").select("rec", "client", "kind", F.col("brand").alias("word"), F.col("business").alias("given"), F.lit("").alias("middle"), (F.col("business") == "").alias("weak"), F.lit(None).cast("struct<word:string,given:string,middle:string>").alias("turn"))
    return p.select(*c.columns).unionByName(c).withColumn("node", F.xxhash64("kind", "word", "given", "middle"))


def _turned(parts: str | Column) -> Column:
    """The first part put last."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1))


def _named(parts: str | Column) -> tuple[Column, Column, Column]:
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.split(F.element_at(parts, -1), "-")[0].alias("word"), parts[0].alias("given"), F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("middle")


def _full(given: str) -> Column:
    """A known short form spelt out."""
    short = F.map_from_entries(F.from_json(F.lit(json.dumps([{"k": k, "v": v} for k, v in SHORT.items()])), "array<struct<k:string,v:string>>"))
    return F.coalesce(F.try_element_at(short, F.col(given)), F.col(given))


def given_pairs(given: DataFrame) -> DataFrame:
    """``ga, gb``: given names (``given, n``) that may be one: equal, within one edit by the tries if one is much rarer,
    or a rarer short form in -o, -os, -is or -i and a longer name that begins with its stem."""
    near_ = trie_join(given.select(F.col("given").alias("word")), given.select(F.col("given").alias("word")), SHORTEST_GIVEN).where("length(q) + length(c) >= 7").toDF("ga", "gb")
    stems = given.where(F.col("given").rlike("^.{2,4}(?:os|is|o|i)$") & (F.length("given") <= 6)).select(F.col("given").alias("ga"), F.regexp_replace("given", "(?:os|is|o|i)$", "").alias("stem"))
    starts = given.where(F.length("given") > 3).select(F.col("given").alias("gb"), F.explode(F.expr("transform(sequence(2, least(5, length(given))), i -> left(given, i))")).alias("stem"))
    short = stems.join(starts, "stem").select("ga", "gb", F.lit(True).alias("short"))
    both = near_.withColumn("short", F.lit(False)).unionByName(short).where("ga <> gb").join(given.toDF("ga", "na"), "ga").join(given.toDF("gb", "nb"), "gb")
    rare = F.least("na", "nb") <= F.lit(RARER) * F.greatest("na", "nb") + 1
    both = both.where(rare & (~F.col("short") | (F.col("na") <= F.col("nb")))).select("ga", "gb")
    same = given.select(F.col("given").alias("ga"), F.col("given").alias("gb"))
    return same.union(both).union(both.select("gb", "ga")).distinct()


def links(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``a, b``: nodes that name the same entity, ``b`` being a client's. Weak nodes have no links here. A person's parts
    are compared in the order they have as a node, and turned."""
    strong = nodes.where(~F.col("weak")).groupBy("node", "kind", "word", "given", "middle").agg(F.max("client").alias("client"), F.first("turn").alias("turn"))
    m = neighbours.select("q", "c")
    kw = F.concat("kind", "word")
    firms = strong.where("kind = 'C'")
    left = firms.select(F.col("node").alias("a"), kw.alias("q"), "given").join(m, "q").select("a", "c", "given")
    same = left.join(firms.where("client").select(F.col("node").alias("b"), kw.alias("c"), "given"), ["c", "given"]).where("a <> b").select("a", "b")
    people = strong.where("kind = 'P'")
    asked = people.select(F.col("node").alias("a"), kw.alias("q"), F.col("given").alias("ga"), F.col("middle").alias("ma"))
    turned = people.where(F.length("turn.given") > 1).select(F.col("node").alias("a"), F.concat(F.lit("P"), "turn.word").alias("q"), F.col("turn.given").alias("ga"), F.col("turn.middle").alias("ma"))
    known = nodes.where("kind = 'P'").groupBy("given").agg(F.count("*").alias("n"))
    asked = checkpointed(asked.union(turned).join(m, "q").select("a", "c", "ga", "ma"))
    # Given names that stand last in a name are asked for as such, too.
    known = known.union(asked.select("ga").distinct().join(known, F.col("ga") == F.col("given"), "left_anti").select("ga", F.lit(1)))
    b = people.where("client").select(F.col("node").alias("b"), kw.alias("c"), F.col("given").alias("gb"), F.col("middle").alias("mb"))
    pairs = asked.join(checkpointed(given_pairs(known)), "ga").join(b, ["c", "gb"]).where("a <> b")
    first = lambda c: F.left(c, F.lit(1))
    middle = (F.col("ma") == "") | (F.col("mb") == "") | (((F.length("ma") == 1) | (F.length("mb") == 1)) & (first("ma") == first("mb"))) | (F.levenshtein("ma", "mb") <= 1) | ((F.levenshtein("ma", "mb") == 2) & (F.length("ma") == F.length("mb")) & (F.length("ma") > 3) & (F.array_sort(F.split("ma", "")) == F.array_sort(F.split("mb", ""))))
    return same.union(pairs.where(middle).select("a", "b")).distinct()


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``node, label``: the least node of each component, by label passing until nothing changes."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(vertices.select("node", F.col("node").alias("label")).distinct())
    while True:
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("l"))
        nxt = labels.join(least, labels["node"] == least["a"], "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), (F.col("l") < F.col("label")).alias("moved"))
        # A label's own label is nearer to the least: halves the way.
        root = nxt.select(F.col("node").alias("r"), F.col("label").alias("rl"))
        nxt = checkpointed(nxt.join(root, nxt["label"] == root["r"], "left").select("node", F.least("label", F.coalesce("rl", "label")).alias("label"), "moved"))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def linked(clients: DataFrame, findings: DataFrame) -> DataFrame:
    """``rec, client, entity``: records that name a known entity; equal entities are the same person or organisation."""
    nodes = checkpointed(nodes_of(named_records(clients, findings)))
    kw = F.concat("kind", "word")
    index = nodes.where("client").select(kw.alias("word"))
    # Kind is the first letter of the words joined: a person's surname and a brand never meet.
    counted = nodes.groupBy(kw.alias("word")).agg(F.count("*").alias("n"))
    turned = nodes.where("kind = 'P'").select(F.concat(F.lit("P"), "turn.word").alias("word"))
    near_ = trie_join(counted.select("word").union(turned), index).where(F.left("q", F.lit(1)) == F.left("c", F.lit(1)))
    # Short words within one edit are mostly different ones, unless one is much rarer.
    near_ = near_.join(counted.toDF("q", "n"), "q", "left").join(counted.toDF("c", "m"), "c").withColumn("n", F.coalesce("n", F.lit(1)))
    near_ = checkpointed(near_.where((F.col("q") == F.col("c")) | (F.length("c") > FUZZY_FROM) & (F.length("q") >= FUZZY_FROM) | (F.least("n", "m") <= RARER * F.greatest("n", "m"))).select("q", "c"))
    asked = near_.select("q").distinct()
    reach = checkpointed(nodes.join(asked, kw == F.col("q"), "left_semi").unionByName(nodes.join(asked, kw == F.col("q"), "left_anti").join(asked, F.concat("kind", "turn.word") == F.col("q"), "left_semi")))
    strong = reach.where(~F.col("weak"))
    of_record = strong.where("client").withColumn("b", F.min("node").over(Window.partitionBy("rec"))).where("node <> b").select(F.col("node").alias("a"), "b")
    labels = checkpointed(components(links(reach, near_).union(of_record), strong))
    # Weak names: the components they fit, if just one.
    by_word = strong.join(labels, "node").select(kw.alias("c"), F.when(F.col("kind") == "P", F.left("given", F.lit(1))).otherwise("").alias("first"), "label").distinct()
    weak = reach.where("weak").select("node", kw.alias("q"), F.when(F.col("kind") == "P", F.col("given")).otherwise("").alias("first")).distinct()
    back = near_.select("q", "c").union(near_.select("c", "q")).distinct()
    fits = weak.join(back, "q").join(by_word, ["c", "first"]).select("node", "label")
    own = reach.where("weak and client").select("rec", "node").join(strong.where("client").select("rec", F.col("node").alias("s")), "rec").join(labels.withColumnRenamed("node", "s"), "s").select("node", "label")
    one = fits.union(own).groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    weak_labels = weak.select("node").join(one, "node", "left").select("node", F.when(F.col("lo").isNull(), F.col("node")).when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))
    of_node = labels.unionByName(weak_labels).where("label is not null")
    found = reach.select("rec", "client", "node", "weak").join(of_node, "node")
    # A record goes by its full names; by weak ones only if it has no other.
    return found.groupBy("rec", "client").agg(F.coalesce(F.min(F.when(~F.col("weak"), F.col("label"))), F.min("label")).alias("entity"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "clients"), table(spark, sf_dir, "privacy_findings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = checkpointed(p2_entities(spark, sf_dir))
    a = e.where("client").select(F.col("rec").alias("id_a"), "entity")
    b = e.select(F.col("rec").alias("id_b"), "entity")
    return a.join(b, "entity").where("id_a < id_b").select("id_a", "id_b")


def queries():
    return {"p2_found": p2_found, "p2_entities": p2_entities}


def oracle_sql():
    return {}
