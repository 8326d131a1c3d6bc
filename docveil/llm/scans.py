"""Noise in text from scanned pages (problem 4).

All of it is SQL. Lines are exploded with their neighbours. Page numbers and running headers are edge lines; the latter
recur on pages of a document in the same skeleton, in which confusable letters are one. A word split at a line's end is
told from a compound by how often either form occurs in the corpus. Misread words are found by anagram hashes: the sum
of its letters' values changes by a known difference when one letter is taken for another, so rare words are joined
with frequent ones on their hash less that difference, and the substitution is then verified in place; what is left is
joined once more, on two differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm import lookalikes, mojibake
from docveil.llm.inputs import rows_of, union
from docveil.operators.lineage import checkpointed

#: A frequent word occurs this often at least, and this many times as often as the rare word taken for its misreading.
FREQUENT, RATIO = 4, 15
#: Shortest word looked at.
SHORTEST = 3
#: Shortest word in which two places may be misread: with two changed, shorter ones are other words.
TWICE_FROM = 5
#: Lines before and after in which a header's next like is sought, among the set-off edge lines of the pages in order.
NEXT = 4
#: What is read, and what was printed.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("lc", "k"), ("lı", "h"), ("li", "h"), ("ii", "u"), ("ii", "ü"), ("ri", "n"), ("n", "ri"), ("m", "in"), ("in", "m"), ("nı", "m"), ("vv", "w"), ("w", "vv"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("u", "a"), ("v", "y"), ("y", "v"), ("f", "t"), ("t", "f"), ("fl", "tl"), ("l", "i"), ("i", "l"), ("l", "ı"), ("ı", "l"), ("l", "t"), ("t", "l"), ("r", "n"),
    ("q", "g"), ("g", "q"), ("h", "b"), ("b", "h"), ("u", "n"), ("n", "u"), ("1", "l"), ("1", "i"), ("1", "ı"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z"), ("f", "e"), ("e", "f"), ("p", "r"),
    ("ti", "tı"), ("0", "ö"), ("6", "ö"), ("j", "i"), ("tu", "tıı"), ("iı", "u"), ("ıı", "u"), ("ıi", "ü"), ("ın", "m"), ("m", "ın"), ("k", "lc"), ("h", "li"),
)
#: Words before a page number.
PAGE_WORDS = "sayfa|sahife|page|pagina|seite|pag|s|p"
#: Letters taken for one another in headers, as one; applied after the pairs.
SKELETON_PAIRS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("lc", "k"), ("ii", "u"), ("vv", "w"), ("li", "h"))
SKELETON = ("eao01itfjq5v8", "cccclllllgsyb")

_BREAK = "[-‐‑¬­－]"


def _folded(line: Column) -> Column:
    """Lower case the Turkish way, look-alikes and widths undone."""
    pairs = [(chr(c), to) for c, (to, kind) in lookalikes.mapping().items() if kind in ("letter", "width") and len(to) == 1 and c < 0x10000]
    plain = F.translate(line, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    odd = line.rlike(f"[^\\x00-\\x7F{mojibake.NATURAL}¬]")
    return F.lower(F.translate(F.when(odd, F.regexp_replace(plain, r"[\p{Cf}]", "")).otherwise(line), "İI", "iı"))


def _split(texts: DataFrame) -> DataFrame:
    return texts.where("trim(text) <> ''").select("src", "row_key", "doc", "page", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("ls"))


def lines_of(texts: DataFrame) -> DataFrame:
    """``src, row_key, line_no, line, before, after``: lines that are not blank, with their neighbours as they stand."""
    t = _split(texts)
    n, none = F.size("ls"), F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(F.col("ls").alias("line"), F.concat(none, F.slice("ls", F.lit(1), n - 1)).alias("before"), F.concat(F.slice("ls", F.lit(2), n), none).alias("after"))
    return t.select("src", "row_key", F.posexplode(zipped).alias("i", "x")).select("src", "row_key", (F.col("i") + 1).cast("long").alias("line_no"), "x.line", "x.before", "x.after").where(F.trim("line") != "")


def edge_lines(texts: DataFrame, reach: int = 3) -> DataFrame:
    """The first and last lines of each page that are not blank, all lines of a gold text: as in ``lines_of``, with
    ``doc, page``, the rank ``edge`` from the nearer end (1 is the edge) and whether that is the ``top``."""
    t = _split(texts).withColumn("full", F.expr("filter(transform(ls, (x, i) -> IF(trim(x) <> '', i, -1)), i -> i >= 0)"))
    ends = F.array_distinct(F.concat(F.slice("full", 1, reach), F.slice("full", F.greatest(F.size("full") - reach + 1, F.lit(1)), F.lit(reach))))
    t = t.where(F.size("full") > 0).withColumn("i", F.explode(F.when(F.col("src") == "gold_labels", F.col("full")).otherwise(ends))).withColumn("rank", F.array_position("full", F.col("i")))
    return t.select(
        "src", "row_key", "doc", "page", (F.col("i") + 1).cast("long").alias("line_no"), F.get("ls", F.col("i")).alias("line"), F.when(F.col("i") > 0, F.get("ls", F.col("i") - 1)).alias("before"), F.get("ls", F.col("i") + 1).alias("after"),
        F.least(F.col("rank"), F.size("full") + 1 - F.col("rank")).alias("edge"), (F.col("rank") * 2 <= F.size("full")).alias("top"),
    )


def page_number(line: Column) -> Column:
    return F.length(F.trim(line)).between(1, 24) & _folded(F.trim(line)).rlike(rf"^[^\p{{L}}\p{{N}}]*(?:(?:{PAGE_WORDS})\s*[.:]?\s*)?[0-9oıil]{{0,3}}[0-9][0-9oıil]{{0,3}}(?:\s*(?:[-/]|of|von|di|de|sur)\s*[0-9oıil]{{1,4}})?[^\p{{L}}\p{{N}}]*$")


def _skeleton(line: Column) -> Column:
    s = F.regexp_replace(_folded(line), rf"\s+(?:{PAGE_WORDS})\.?\s*[0-9oıil]+\s*$", "")
    # ASCII alone is kept: what was wrongly decoded differs in the rest.
    s = F.regexp_replace(F.translate(s, "ı", "i"), r"[^a-z0-9]+", "")
    for a, b in SKELETON_PAIRS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, *SKELETON)


def _sets_off(line: str = "line") -> Column:
    """The line is no part of a sentence that goes on before or after it."""
    before, after = F.rtrim(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    starts_low = after.rlike(r"^\s{0,2}[\p{Ll}]")
    ends_open = (before != "") & before.rlike(rf"[\p{{Ll}},;]$|{_BREAK}$") & F.col(line).rlike(r"^\s*\p{Ll}")
    return ~starts_low & ~ends_open & ~F.trim(line).rlike(r"[.!?;,]$|" + _BREAK + "$") & (F.length(F.trim(line)) <= 90) & F.col(line).rlike(r"\p{L}{3}")


def headers(lines: DataFrame) -> DataFrame:
    """``src, row_key, line_no``: edge lines whose skeleton recurs on two pages of the document, or twice in a gold text."""
    near = lines.where(_sets_off() & ~page_number(F.col("line"))).withColumn("bone", _skeleton(F.col("line"))).where(F.length("bone") >= 4)
    near = near.select("src", "row_key", "doc", "line_no", "bone", "top", "edge", F.when(F.col("src") == "gold_labels", F.col("line_no")).otherwise(F.col("page")).alias("at"))
    # Read four times.
    near = checkpointed(near)
    seen = near.groupBy("src", "doc", "bone").agg(F.count_distinct("at").alias("n")).where("n >= 2").select("src", "doc", "bone")
    same = near.join(seen, ["src", "doc", "bone"], "left_semi")
    # Not letter for letter: compared with the document's own recurring lines, of which there are a few, and with the
    # like lines of the pages next to it, as no two may be the same. A line counts once a page, however often scanned.
    close = lambda other: (F.abs(F.length("bone") - F.length(other)) <= 15) & (F.levenshtein("bone", other) <= F.greatest(F.lit(1), F.floor(F.length("bone") / 6)))
    fuzzy = near.join(seen, ["src", "doc", "bone"], "left_anti").join(seen.withColumnRenamed("bone", "known"), ["src", "doc"]).where(close(F.col("known")))
    place = F.when(F.col("src") == "gold_labels", False).otherwise(F.col("top"))
    once = near.groupBy("src", "doc", place.alias("place"), "at", "bone").agg(F.min("line_no").alias("line_no"))
    w = Window.partitionBy("src", "doc", "place").orderBy("at", "line_no", "bone")
    like = F.lit(False)
    for k in range(1, NEXT + 1):
        for side in (F.lag, F.lead):
            other = side(F.struct("bone", "at"), k).over(w)
            like = like | F.coalesce((other["at"] != F.col("at")) & (F.length("bone") >= 10) & close(other["bone"]), F.lit(False))
    alike = once.withColumn("like", like).where("like").select("src", "doc", "place", "at", "bone")
    beside = near.withColumn("place", place).join(alike, ["src", "doc", "place", "at", "bone"], "left_semi")
    cols = ["src", "row_key", "line_no"]
    return same.select(*cols).union(fuzzy.select(*cols)).union(beside.select(*cols)).distinct()


_WORD = r"[\p{L}\p{N}]+(?:[-‐][\p{L}\p{N}]+)*"


def _value(s: Column) -> Column:
    """Anagram hash: a sum over letters, so their order does not matter; 40 bits a letter."""
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << 40))))


def split_ends(lines: DataFrame) -> DataFrame:
    """Lines that end in a break sign with a letter before it and a letter at the start of the next line:
    ``src, row_key, line_no, head, rest`` (the two pieces), ``own`` (the sign is no hyphen but a break mark)."""
    end = rf"([\p{{L}}\p{{N}}\p{{Cf}}’']+)\s?({_BREAK})\s*$"
    b = lines.where(F.col("line").rlike(rf"[\p{{L}}\p{{Cf}}]{_BREAK}\s*$") & F.coalesce("after", F.lit("")).rlike(r"^\s*\p{L}"))
    return b.select(
        "src", "row_key", "line_no", _folded(F.regexp_extract("line", end, 1)).alias("head"), F.regexp_extract("line", end, 1).alias("raw_head"),
        _folded(F.regexp_extract("after", r"^\s*([\p{L}\p{N}\p{Cf}]+)", 1)).alias("rest"), F.regexp_extract("after", r"^\s*(\S+)", 1).alias("raw_rest"),
        F.regexp_extract("line", end, 2).isin("¬", "­").alias("own"), F.regexp_extract("line", rf"(\S*){_BREAK}\s*$", 1).alias("token"),
    )


def _no_addresses(line: str) -> Column:
    return F.when(F.contains(line, F.lit("@")), F.regexp_replace(line, r"\S*@\S*", " ")).otherwise(F.col(line))


def _breaks(line: str) -> Column:
    """The line ends in a break sign after a letter."""
    return F.coalesce(F.right(F.rtrim(line), F.lit(2)).rlike(rf"^\p{{L}}{_BREAK}$"), F.lit(False))


def tokens(lines: DataFrame) -> DataFrame:
    """``src, row_key, line_no, word``: words of the lines; a word split at the line's end is put together and counts
    for the line it begins in. Words of addresses in the net are left out."""
    clean = _no_addresses("line")
    # Words with a character of problems 5 or 7 are theirs.
    odd = rf"[^\x00-\x7f{mojibake.NATURAL}¬’–—“”«»§°²³½№™]"
    clean = F.when(F.col("line").rlike(odd), F.regexp_replace(clean, rf"\S*{odd}\S*", " ")).otherwise(clean)
    broken = _breaks("line") & F.coalesce("after", F.lit("")).rlike(r"^\s*\p{Ll}")
    joined = F.when(broken, F.concat(F.regexp_replace(clean, rf"\s?{_BREAK}\s*$", ""), F.regexp_extract("after", r"^\s*([\p{L}\p{N}]+)", 1))).otherwise(clean)
    followed = _breaks("before") & F.col("line").rlike(r"^\s*\p{Ll}")
    body = F.when(followed, F.regexp_replace(joined, r"^\s*[\p{L}\p{N}]+", "")).otherwise(joined)
    return lines.select("src", "row_key", "line_no", F.explode(F.regexp_extract_all(F.lower(F.translate(body, "İI", "iı")), F.lit(_WORD), F.lit(0))).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _held(words: DataFrame, word: str, conf: DataFrame, held: str) -> DataFrame:
    """``words`` with each confusion whose ``held`` side occurs in them, met by equality: a word is exploded to its
    pieces, of which none is longer than the longest confusion."""
    pieces = F.array_distinct(F.flatten(F.array(*(F.expr(f"IF(length({word}) >= {k}, transform(sequence(1, length({word}) - {k - 1}), i -> substr({word}, i, {k})), array())") for k in (1, 2, 3)))))
    return words.withColumn(held, F.explode(pieces)).join(conf, held)


def _sides(spark: SparkSession, vocab: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words that may be rare by each confusion they may hold, with the hash when it is undone; frequent words; the confusions."""
    v = vocab.where((F.length("word") >= SHORTEST) & F.col("word").rlike(r"\p{L}"))
    conf = F.broadcast(
        spark.createDataFrame(CONFUSIONS, "seen string, meant string").select("seen", "meant", (_value(F.col("meant")) - _value(F.col("seen"))).alias("diff"))
    )
    plain = f"^[a-z0-9{mojibake.NATURAL}-]+$"
    rare = _held(v.where(F.col("word").rlike(plain)).withColumn("own", _value(F.col("word"))), "word", conf, "seen").select("word", "n", "seen", "meant", (F.col("own") + F.col("diff")).alias("h"))
    frequent = v.where((F.col("n") >= FREQUENT) & ~F.col("word").rlike(r"\p{N}")).select(F.col("word").alias("correction"), F.col("n").alias("m"), _value(F.col("word")).alias("h"))
    return rare, frequent, conf


def misreadings(spark: SparkSession, vocab: DataFrame) -> DataFrame:
    """``word, correction``: rare words that become a much more frequent one when one confusion is undone. Of several
    the most frequent is taken."""
    rare, frequent, _ = _sides(spark, vocab)
    at_place = F.expr("exists(sequence(1, length(word)), i -> substr(word, i, length(seen)) = seen AND concat(left(word, i - 1), meant, substr(word, i + length(seen))) = correction)")
    hits = rare.join(frequent, "h").where((F.col("m") >= RATIO * F.col("n")) & at_place)
    return hits.groupBy("word").agg(F.max_by("correction", F.struct("m", "correction")).alias("correction"))


def misread_twice(spark: SparkSession, vocab: DataFrame, once: DataFrame) -> DataFrame:
    """``word, correction``: as in ``misreadings``, which gave ``once``, of the words left where two confusions (or one
    twice) are undone at different places.

    They meet half way: a rare word's hash with one undone is a frequent word's with the other one done."""
    rare, frequent, conf = _sides(spark, vocab)
    rare = rare.where(F.length("word") >= TWICE_FROM).join(once.select("word"), "word", "left_anti")
    done = _held(frequent.where(F.col("m") >= RATIO), "correction", F.broadcast(conf.toDF("seen2", "meant2", "diff2")), "meant2").select("correction", "m", "seen2", "meant2", (F.col("h") - F.col("diff2")).alias("h"))
    at_places = F.expr(
        "exists(sequence(1, length(word)), i -> substr(word, i, length(seen)) = seen AND left(correction, i - 1 + length(meant)) = concat(left(word, i - 1), meant) AND exists(sequence(i + length(seen), length(word) + 1), j -> substr(word, j, length(seen2)) = seen2 "
        "AND concat(left(word, i - 1), meant, substr(word, i + length(seen), j - i - length(seen)), meant2, substr(word, j + length(seen2))) = correction))"
    )
    hits = rare.join(done, "h").where((F.col("m") >= RATIO * F.col("n")) & at_places)
    return hits.groupBy("word").agg(F.max_by("correction", F.struct("m", "correction")).alias("correction"))


#: Letters that digits are misread for, in small letters, and these digits.
AS_LETTERS, AS_DIGITS = "oıilszb", "0111526"


def shapes(vocab: DataFrame) -> DataFrame:
    """``shape, number``: shapes of words of letters and digits that are misread: a ``number`` with letters in the place
    of digits, or a word with a digit in the place of a letter.

    The words of such shapes are mostly rare (numbers, names), so it is shapes that are counted, digits as 9 and, for
    words, letters as a. A shape's anagram hash changes by the known differences when all its confusions are undone at
    once; it is joined with the frequent shapes on that hash, and the substitution is verified in place."""
    part = vocab.select(F.explode(F.split("word", "[-‐]")).alias("p"), "n").where("p <> ''").withColumn("s", F.regexp_replace("p", "[0-9]", "9"))
    letters, digits = F.col("s").rlike(r"\p{L}"), F.col("s").contains("9")
    as_word = F.regexp_replace("s", r"\p{L}", "a")
    counted = part.groupBy(F.when(letters & digits, F.col("s")).when(letters, as_word).otherwise(F.col("s")).alias("s"), (letters & digits).alias("mixed")).agg(F.sum("n").alias("n"))
    frequent = counted.where(f"NOT mixed AND n >= {FREQUENT}").select(F.col("s").alias("printed"), F.col("n").alias("m"), _value(F.col("s")).alias("h"))
    diffs = lambda seen, meant: sum((F.length(seen) - F.length(F.translate(seen, c, ""))) * (_value(F.lit(meant)) - _value(F.lit(c))) for c in AS_LETTERS)
    s = F.col("s")
    numbers = counted.where("mixed").select("s", "n", F.lit(True).alias("number"), F.translate(s, AS_LETTERS, "9" * len(AS_LETTERS)).alias("undone"), (_value(s) + diffs(s, "9")).alias("h"))
    words = counted.where("mixed").groupBy(as_word.alias("s")).agg(F.sum("n").alias("n")).select("s", "n", F.lit(False).alias("number"), F.translate("s", "9", "a").alias("undone"), (_value(s) + (F.length(s) - F.length(F.translate(s, "9", ""))) * (_value(F.lit("a")) - _value(F.lit("9")))).alias("h"))
    hits = numbers.unionByName(words).join(frequent, "h").where((F.col("m") >= RATIO * F.col("n")) & (F.col("undone") == F.col("printed")))
    return hits.select(F.col("s").alias("shape"), "number").distinct()


def misshapen(words: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``words`` (column ``word``) a part of which has one of the ``known`` shapes; adds ``correction``, the
    number read with digits, null for words."""
    mixed = words.where(F.col("word").rlike(r"\p{L}") & F.col("word").rlike("[0-9]"))
    shape = F.regexp_replace(F.col("p"), "[0-9]", "9")
    both = F.array(F.struct(shape.alias("shape"), F.lit(True).alias("number")), F.struct(F.regexp_replace(shape, r"\p{L}", "a").alias("shape"), F.lit(False).alias("number")))
    parts = mixed.withColumn("p", F.explode(F.split("word", "[-‐]"))).withColumn("x", F.explode(both)).select(*words.columns, "x.*")
    return parts.join(known, ["shape", "number"]).withColumn("correction", F.when(F.col("number"), F.translate("word", AS_LETTERS, AS_DIGITS))).drop("shape", "number")


#: Misread words that are broadcast, at most: about 10 MB.
BROADCAST_ROWS = 200_000
#: Longs in the word filter, at least and at most; a word is one bit of them, and each has sixteen to itself until there
#: are four million words. A long is a row of some 30 bytes where it is broadcast: 30 MB at most.
FILTER = (1 << 15, 1 << 20)


def _filtered(words: DataFrame, keep: DataFrame, count: int) -> DataFrame:
    """Those of ``words`` that may be among the ``count`` of ``keep``: by a bit map as long as these need, up to a fixed
    length, so that the join need not shuffle all."""
    size = min(max(1 << (count * 16 // 64).bit_length(), FILTER[0]), FILTER[1])
    h = F.pmod(F.xxhash64("word"), F.lit(size * 64))
    bits = keep.select(F.floor(h / 64).alias("slot"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(word), {size * 64}) % 64))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    # One row a slot that holds a bit: bounded by the filter's length, and met where the words are.
    test = F.expr(f"(shiftright(bits, int(pmod(xxhash64(word), {size * 64}) % 64)) & 1) = 1")
    return words.withColumn("slot", F.floor(h / 64)).join(F.broadcast(checkpointed(bits)), "slot").where(test).select(*words.columns)


#: A number with a letter in the place of a digit (identity papers have one in front, house numbers one
#: behind), and a word with a digit in the place of a letter.
ODD_NUMBER = (
    r"(?:^|[\s(+:/-])(?:\d[\d.,/-]*[OolISBZb][\d.,/-]*\d[\dOolISBZb.,/-]*|\d[\d.,/-]*[OolISZ]|[OolISBZ]\d{1,5}|[Ool]\d{6,})(?=$|[\s).,;:/-])"
)
ODD_WORD = r"(?<![\p{L}\p{N}@._-])(?:\p{L}+[01568]\p{Ll}+|\p{Lu}{2,}[01568]\p{Lu}+|[056]\p{Ll}{3,})(?![\p{L}\p{N}]*@)"


def defects(texts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Defects of ``src, row_key, doc, page, text``: ``src, row_key, line_no BIGINT, defect, word, correction``.

    ``doc`` and ``page`` say which document and page a text is (gold texts are documents of their own). Null and blank
    texts have none. A page given twice counts once, two scans of one page are one page as regards recurring headers.
    """
    spark = texts.sparkSession
    # Read several times; a row delivered twice would double its words' counts.
    texts = checkpointed(texts.select("src", "row_key", "doc", "page", "text").dropDuplicates(["src", "row_key"]))
    lines = lines_of(texts)
    key = ["src", "row_key", "line_no"]
    gold = F.col("src") == "gold_labels"
    edges = checkpointed(edge_lines(texts))
    # In a page, a number stands at the edge; in the text of a whole document, not below the rows of a table.
    in_table = F.coalesce("before", F.lit("")).rlike(r"^\s*\d+\s{2,}\S")
    pages = edges.where(page_number(F.col("line")) & ((~gold & (F.col("edge") <= 2)) | (gold & ~in_table))).select(*key)
    removed = headers(edges).select(*key, F.lit("header").alias("defect")).union(pages.select(*key, F.lit("page_number").alias("defect")))
    nothing = F.lit(None).cast("string")
    removed = checkpointed(removed.distinct()).select("*", nothing.alias("word"), nothing.alias("correction"))
    vocab = checkpointed(vocabulary(tokens(lines)))
    # Hyphens.
    ends = checkpointed(split_ends(lines))
    ends = ends.withColumn("one", F.concat("head", "rest")).withColumn("two", F.concat("head", F.lit("-"), "rest"))
    looked = checkpointed(vocab.join(ends.select(F.explode(F.array("one", "two")).alias("word")).distinct(), "word", "left_semi"))
    ends = ends.join(looked.select(F.col("word").alias("one"), F.col("n").alias("n_one")), "one", "left").join(looked.select(F.col("word").alias("two"), F.col("n").alias("n_two")), "two", "left")
    upper = F.col("raw_rest").rlike(r"^\p{Lu}")
    caps = upper & F.col("raw_head").rlike(r"\p{Lu}\p{Lu}$|^\p{Lu}$") & F.col("raw_rest").rlike(r"^\p{Lu}\p{Lu}")
    n1, n2 = F.coalesce("n_one", F.lit(0)), F.coalesce("n_two", F.lit(0))
    # A split word is counted as one word by itself; compounds are known from where they stand within a line.
    hyphen = F.col("own") | (~F.col("raw_rest").contains("@") & ~F.col("token").contains("@") & (~upper | caps) & ((n2 == 0) | (n1 - 1 > 4 * n2)))
    hyphens = ends.where(hyphen).select(*key, F.lit("hyphen").alias("defect"), F.concat("raw_head", F.lit("-"), "raw_rest").alias("word"), F.lit(None).cast("string").alias("correction"))
    # Misread words.
    once = checkpointed(misreadings(spark, vocab))
    wrong = checkpointed(once.unionByName(misread_twice(spark, vocab, once)))
    # Body lines only: what has no small letter is a title.
    body = lines.where(F.col("line").rlike(r"\p{Ll}"))
    # A short list goes to every task; a longer one is met by a shuffle, of the words that may be in it.
    count, found = wrong.count(), tokens(body)
    hit = found.join(F.broadcast(wrong), "word") if count <= broadcast_rows else _filtered(found, wrong, count).join(wrong, "word")
    words = hit.select(*key, F.lit("misread").alias("defect"), "word", "correction")
    # What the shapes found stands as it must: a letter within a number, a digit within a word.
    as_must = F.col("line").rlike(r"[0-9]\p{L}|\p{L}[0-9]") & _no_addresses("line").rlike(f"{ODD_NUMBER}|{ODD_WORD}")
    odd = misshapen(tokens(body.where(as_must)), checkpointed(shapes(vocab))).select(*key, F.lit("misread").alias("defect"), "word", "correction")
    misread = words.union(odd).join(removed.select(*key), key, "left_anti")
    return removed.union(hyphens).union(misread).distinct()


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rows_of(spark, sf_dir, "ocr_pages", "ocr_pages", "id", "text", F.col("document_id").cast("string").alias("doc"), F.col("page_number").cast("long").alias("page"))
    gold = rows_of(spark, sf_dir, "gold_labels", "gold_labels", "id", "ocr_text", F.col("id").cast("string").alias("doc"), F.lit(0).cast("long").alias("page"))
    return union(pages, gold)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(inputs(spark, sf_dir)).select("src", "row_key", "line_no", "defect").distinct()


def _as_written(text: Column, word: Column, correction: Column) -> Column:
    """The word replaced by its correction in small letters, with a capital, in capitals; in any other case, small."""
    cap = lambda c: F.concat(F.upper(F.translate(F.left(c, F.lit(1)), "iı", "İI")), F.substr(c, F.lit(2)))
    up = lambda c: F.upper(F.translate(c, "iı", "İI"))
    whole = lambda c, how="": F.concat(F.lit(how + r"(?<![\p{L}\p{N}])"), c, F.lit(r"(?![\p{L}\p{N}])"))
    for form in (lambda c: c, cap, up):
        text = F.regexp_replace(text, whole(form(word)), form(correction))
    return F.regexp_replace(text, whole(word, "(?iu)"), correction)


def repaired(texts: DataFrame) -> DataFrame:
    """``src, row_key, repaired``: running headers and page numbers gone, misread words corrected as they are written,
    split words joined, and lines run on into paragraphs; a blank or indented line begins a new one.

    Texts of which nothing is left give no row. Only defects are joined with texts, which are rebuilt in their row."""
    key, line = ["src", "row_key"], lambda kind: F.collect_set(F.when(kind, F.col("line_no")))
    per = defects(texts).groupBy(*key).agg(
        line(F.col("defect").isin("header", "page_number")).alias("gone"), line(F.col("defect") == "hyphen").alias("split"),
        F.array_sort(F.collect_set(F.when((F.col("defect") == "misread") & F.col("correction").isNotNull() & (F.col("word") != F.col("correction")), F.struct("word", "correction")))).alias("fixes"),
    )
    t = texts.where("trim(text) <> ''").select(*key, "text").dropDuplicates(key).join(per, key, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    t = t.select(*key, F.split(F.regexp_replace("text", "\r", ""), "\n").alias("ls"), none("gone", "array<bigint>"), none("split", "array<bigint>"), none("fixes", "array<struct<word:string,correction:string>>"))
    piece = F.expr(
        f"transform(ls, (x, i) -> CASE WHEN trim(x) = '' OR array_contains(gone, i + 1L) THEN '' ELSE concat(IF(i = 0 OR trim(ls[greatest(i - 1, 0)]) = '' OR x RLIKE '^[ \\t]{{2,}}', '\u0001', ''), "
        f"IF(array_contains(split, i + 1L), regexp_replace(trim(x), '[ ]?{_BREAK}[ ]*$', ''), concat(trim(x), ' '))) END)"
    )
    flow = F.regexp_replace(F.regexp_replace(F.array_join(piece, ""), " ?\u0001", "\n\n"), r"^\s+", "")
    # Corrections come last, when split words are whole.
    t = t.select(*key, "fixes", F.trim(flow).alias("flow")).where("flow <> ''")
    return t.select(*key, F.aggregate("fixes", F.col("flow"), lambda s, x: _as_written(s, x["word"], x["correction"])).alias("repaired"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(inputs(spark, sf_dir))


def queries():
    return {"p4_found": p4_found, "p4_repaired": p4_repaired}


def oracle_sql():
    return {}
