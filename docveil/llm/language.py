"""Missing or wrong document language labels (problem 3).

A convolutional network over bytes: filters of several widths on fixed-length windows, max pooling over positions and
a softmax, trained here in numpy on labelled pages. Sentences are scored over all their windows, the most probable
sequence of languages is taken with a cost for each switch, and its runs are the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docveil.llm import mojibake
from docveil.llm.inputs import rows_of, union
from docveil.llm.personal import UP, Plain
from docveil.sources.tables import table

LANGUAGES = ("tr", "en", "de", "fr", "it")
#: Labelled pages per language the network is trained on, at most; the choice is by a hash of the page's id.
PAGES_PER_LANGUAGE = 500
#: Sentences per language and pass over them.
SENTENCES_PER_LANGUAGE, EPOCHS = 2500, 3
#: Windows gone over in training, at least.
TRAINED_WINDOWS = 70_000
#: Bytes of a window; dimensions of a byte's embedding; filters of each width.
LENGTH, EMBED, WIDTHS, FILTERS = 64, 8, (3, 4, 5), 24
#: Cost of a switch of language between sentences, in nats.
SWITCH = 2.5
#: Words a sentence needs at least.
WORDS = 4
#: A text's language is told where its mean probability reaches this; below it, it is unknown.
TOLD = 0.6
#: Temperatures tried: a network is surer of itself than it is right, by how much is told by sentences held out.
TEMPERATURES = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0)

#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = frozenset(
    "ref av dr prof doç no nr ltd şti sti san tic a.ş a.s t.c mah cad sok sk blv bul apt d k kat vb vs bkz md sy st str bd ave rd mr mrs ms inc co corp art abs ziff "
    "me mme mlle dott avv sig v.le p.zza s.p.a s.r.l n num tel fax c.so u.a z.b usw etc ecc ca bzw e.v hizm sağ loj mob inş tur dan eski esas e".split()
)
#: What an ordinal number with a point stands before: courts, notaries, streets, months.
_ORDINAL = re.compile(
    r"(?:noter|asliye|sulh|aile|iş |is |ağır|agir|icra|idare|vergi|ticaret|tüketici|hukuk|ceza|bölge|madde|kat\b|sk\.|sok|cad|blv|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|instanz|kammer|abs)", re.I
)
_END = re.compile(r"([.!?])[\"”»’)\]]*\s+(?=[\"“«(\[]?[^\W_])")
_PAGE = re.compile(r"^\W*(?:[^\W\d_]{1,8}\.?\s*)?\d{1,4}(?:\s*(?:[-/]|von|of|de|di|sur|su)\s*\d{1,4})?\W*$")
_WORD = re.compile(r"[^\W\d_]{2,}")
_ADDRESS = re.compile(r"\S*@\S*|\S*\d\S*")
_NAME = re.compile(rf"(?<=[\w,;:)’'\"-] )[{UP}][\w’'.&-]*")


def masked(sentence: str) -> str:
    """What tells a sentence's language: without names, numbers and addresses, as Turkish names stand in German
    sentences and the other way round. A sentence of which too little is left stays whole."""
    bare = re.sub(r"\s+", " ", _NAME.sub("", _ADDRESS.sub("", sentence))).strip()
    return bare if sum(map(str.isalpha, bare)) >= 12 else sentence


def sentences(text: str) -> list[str]:
    """Whole sentences in reading order. Lines are joined, words split at a line's end too; what has no end of its own
    (titles, headers, names) or too few words is none, and page numbers are left out."""
    if len(mojibake.ASKED.findall(text)) >= 2:
        # Question marks in the place of letters end no sentence.
        text = text.replace("?", "ı")
    text = Plain(text).text
    blocks, now = [], []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or line.startswith("  "):
            blocks.append(now)
            now = []
        if bare and not _PAGE.match(bare):
            now.append(bare)
    blocks.append(now)
    out = []
    for block in blocks:
        joined = ""
        for line in block:
            joined = joined[:-1] + line if joined.endswith(("-", "¬", "‐")) and line[:1].islower() else f"{joined} {line}" if joined else line
        at = 0
        for m in _END.finditer(joined):
            if m[1] == ".":
                last = joined[at : m.start()].rsplit(None, 1)
                word = last[-1].replace("İ", "i").lower().lstrip("(\"'“«") if last else ""
                if word.isdigit():
                    if joined[m.end() : m.end() + 1].islower() or _ORDINAL.match(joined, m.end()):
                        continue
                elif len(word) <= 1 or word in ABBREVIATIONS or (len(word) == 2 and "'" in word):
                    continue
            out.append(joined[at : m.end()].strip())
            at = m.end()
        out.append(joined[at:].strip())
    return [s for s in out if s.rstrip("\"”»’)]")[-1:] in (".", "!", "?") and len(_WORD.findall(s)) >= WORDS]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of fixed-length windows, and the text each belongs to. The last window of a text ends with it."""
    rows, owner = [], []
    for n, t in enumerate(texts):
        raw = t.encode("utf-8", "replace")
        if len(raw) <= LENGTH:
            rows.append(raw.ljust(LENGTH, b"\0"))
            owner.append(n)
            continue
        starts = [*range(0, len(raw) - LENGTH, LENGTH), len(raw) - LENGTH]
        rows += [raw[s : s + LENGTH] for s in starts]
        owner += [n] * len(starts)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LENGTH), np.array(owner, np.int64)


class ByteNetwork:
    """Embedding, filters of several widths, max pooling, softmax; trained by Adam on the cross-entropy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(LANGUAGES))).astype(np.float32)
        self.p["bias"] = np.zeros(len(LANGUAGES), np.float32)
        self.temperature = 1.0

    def calibrate(self, texts: list[str], y: np.ndarray) -> None:
        """The temperature at which held-out sentences are most probable; it divides what confidences are made of."""
        lp = sentence_scores(self, texts)

        def loss(t: float) -> float:
            z = lp / t
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

        self.temperature = min(TEMPERATURES, key=loss)

    def confidence(self, lp: np.ndarray) -> np.ndarray:
        p = np.exp(lp / self.temperature)
        return p / p.sum(1, keepdims=True)

    def _columns(self, e: np.ndarray, w: int) -> np.ndarray:
        n = e.shape[0]
        view = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(view).reshape(-1, w * EMBED)

    def features(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e, parts = self.p["embed"][x], []
        for w in WIDTHS:
            cols = self._columns(e, w)
            z = (cols @ self.p[f"w{w}"]).reshape(len(x), LENGTH - w + 1, FILTERS)
            if keep is None:
                top = z.max(1)
            else:
                at = z.argmax(1)
                top = np.take_along_axis(z, at[:, None], 1)[:, 0]
                keep[w] = (cols, at)
            parts.append(top + self.p[f"b{w}"])
        return np.maximum(np.concatenate(parts, 1), 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(LANGUAGES)), np.float32)
        for i in range(0, len(x), 1024):
            z = self.features(x[i : i + 1024]) @ self.p["out"] + self.p["bias"]
            z -= z.max(1, keepdims=True)
            out[i : i + 1024] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        f = self.features(x, keep)
        z = f @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        d = np.exp(z)
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": f.T @ d, "bias": d.sum(0)}
        df = (d @ self.p["out"].T) * (f > 0)
        ge = np.zeros_like(self.p["embed"])
        n = len(x)
        for k, w in enumerate(WIDTHS):
            cols, at = keep[w]
            dz = df[:, k * FILTERS : (k + 1) * FILTERS]
            # Only the position that was largest passes a gradient on: a gather instead of a full product.
            rows = at + (np.arange(n) * (LENGTH - w + 1))[:, None]
            picked = cols[rows.ravel()].reshape(n, FILTERS, -1)
            g[f"w{w}"] = np.einsum("nfk,nf->kf", picked, dz, optimize=True)
            g[f"b{w}"] = dz.sum(0)
            back = dz[:, :, None] * self.p[f"w{w}"].T[None]
            bytes_ = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(ge, bytes_.ravel(), back.reshape(-1, EMBED))
        return g | {"embed": ge}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 3, rate: float = 3e-3) -> None:
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), 128):
                at = order[i : i + 128]
                t += 1
                for k, g in self._gradients(x[at], y[at]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def sentence_scores(net: ByteNetwork, texts: list[str]) -> np.ndarray:
    """Log-probabilities of each sentence: the mean over its windows, scaled as two windows at most, renewed to sum 1."""
    x, owner = windows(texts)
    lp = net.log_probs(x)
    n = np.bincount(owner, minlength=len(texts)).astype(np.float32)
    total = np.stack([np.bincount(owner, lp[:, k], len(texts)) for k in range(lp.shape[1])], 1) / np.maximum(n, 1)[:, None] * np.minimum(n, 2)[:, None]
    total -= total.max(1, keepdims=True)
    return total - np.log(np.exp(total).sum(1, keepdims=True))


def fit(sample: list[tuple[str, str]], seed: int = 7) -> ByteNetwork:
    """Trained on ``(language, text)``. Labels may be wrong: after a first pass, sentences that the network confidently
    gives to another language are relabelled, and a fresh network is trained."""
    rng = np.random.default_rng(seed)
    seen: dict[str, np.ndarray] = {}
    for code, t in sample:
        for s in sentences(t):
            seen.setdefault(masked(s), np.zeros(len(LANGUAGES)))[LANGUAGES.index(code)] += 1
    # A sentence met under several labels has the one in which it has the largest share.
    total = np.maximum(sum(seen.values(), np.zeros(len(LANGUAGES))), 1)
    of = {s: int((n / total).argmax()) for s, n in sorted(seen.items())}
    texts, labels = [], []
    for k in range(len(LANGUAGES)):
        own = [s for s, j in of.items() if j == k]
        if len(own) > SENTENCES_PER_LANGUAGE:
            own = [own[i] for i in rng.choice(len(own), SENTENCES_PER_LANGUAGE, replace=False)]
        texts += own
        labels += [k] * len(own)
    if not texts:
        return ByteNetwork(seed)
    y = np.array(labels)
    x, owner = windows(texts)

    def balanced(y: np.ndarray) -> np.ndarray:
        rows = [np.flatnonzero(y[owner] == k) for k in range(len(LANGUAGES))]
        size = max(map(len, rows))
        return np.concatenate([r if len(r) == size else rng.choice(r, min(size, 6 * len(r))) for r in rows if len(r)])

    for last in (False, True):
        net, at = ByteNetwork(seed), balanced(y)
        # Few distinct sentences are gone over more often.
        passes = max(EPOCHS, -(-TRAINED_WINDOWS // len(at)))
        net.train(x[at], y[owner][at], passes if last else max(1, passes // 3))
        if not last:
            p = np.exp(sentence_scores(net, texts))
            sure = p.max(1) > 0.9
            y = np.where(sure, p.argmax(1), y)
    # The temperature is one of a like network that has not seen every tenth sentence, for these sentences.
    held = np.arange(len(texts)) % 10 == 9
    if held.any() and not held.all():
        trial, at = ByteNetwork(seed), balanced(np.where(held, -1, y))
        trial.train(x[at], y[owner][at], max(1, passes // 3))
        trial.calibrate([t for t, h in zip(texts, held, strict=True) if h], y[held])
        net.temperature = trial.temperature
    return net


def decode(lp: np.ndarray, switch: float = SWITCH, alone: bool = False) -> np.ndarray:
    """The most probable language of each of two or more sentences, a switch costing ``switch``. Unless a sentence may
    stand ``alone``, no language is left after one."""
    if alone:
        return best_path(lp, switch)
    n, k = lp.shape
    new, old = lp[0].astype(np.float64), np.full(k, -np.inf)
    from_new, from_lang = np.zeros((n, k), bool), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(old.argmax())
        from_new[i], from_lang[i] = new >= old, best
        new, old = old[best] - switch + lp[i], np.maximum(new, old) + lp[i]
    path, i, lang, fresh = np.empty(n, np.int64), n - 1, int(old.argmax()), False
    while i >= 0:
        path[i] = lang
        if fresh:
            lang, fresh = int(from_lang[i, lang]), False
        else:
            fresh = bool(from_new[i, lang])
        i -= 1
    return path


def best_path(lp: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The most probable language of each sentence, a switch costing ``switch``; a language may be left at once, as
    stretches are cut by the ends of pages."""
    n, k = lp.shape
    score, back = lp[0].astype(np.float64), np.zeros((n, k), np.int64)
    for i in range(1, n):
        best = int(score.argmax())
        moved = score[best] - switch
        back[i] = np.where(score >= moved, np.arange(k), best)
        score = np.maximum(score, moved) + lp[i]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _segmenter(net: ByteNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            per = [sentences(t) for t in batch.column(2).to_pylist()]
            # Sentences that recur in the batch are scored once.
            number: dict[str, int] = {}
            at = [[number.setdefault(masked(s), len(number)) for s in ss] for ss in per]
            lp = sentence_scores(net, list(number)) if number else None
            out = []
            for a, b, own in zip(src, keys, at, strict=True):
                if len(own) < 2:
                    continue
                path, scores, seg, i = decode(lp[own], alone=True), net.confidence(lp[own]), 0, 0
                while i < len(own):
                    j = i
                    while j + 1 < len(own) and path[j + 1] == path[i]:
                        j += 1
                    if j > i:
                        seg += 1
                        out.append((a, b, seg, LANGUAGES[path[i]], i + 1, j + 1, float(scores[i : j + 1, path[i]].mean())))
                    i = j + 1
            cols = list(zip(*out, strict=True)) or [[] for _ in range(7)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["src", "row_key", "seg_no", "lang", "first_sentence", "last_sentence", "confidence"])

    return run


def _labeller(net: ByteNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, keys, texts = (c.to_pylist() for c in batch.columns)
            # What holds no whole sentence is scored as it stands, if it has words.
            per = [sentences(t) or ([flat] if _WORD.search(flat := re.sub(r"\s+", " ", t).strip()) else []) for t in texts]
            number: dict[str, int] = {}
            at = [[number.setdefault(masked(s), len(number)) for s in ss] for ss in per]
            conf = net.confidence(sentence_scores(net, list(number))) if number else None
            lang, sure = [], []
            for ss, own in zip(per, at, strict=True):
                # Sentences count by their length.
                p = np.average(conf[own], 0, [len(s) for s in ss]) if own else np.zeros(len(LANGUAGES))
                lang.append(LANGUAGES[p.argmax()] if p.max() >= TOLD else None)
                sure.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(keys, pa.string()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["src", "row_key", "lang", "confidence"])

    return run


def languages(texts: DataFrame, net: ByteNetwork) -> DataFrame:
    """``src, row_key, lang, confidence`` of each text of ``src, row_key, text``: the language of most of it.

    ``lang`` is null where no language is probable enough, as in texts of a language that is not known, evenly mixed ones
    and those without words (confidence 0). Null and blank texts give no row; repeated rows come out once per row given."""
    return texts.where("trim(text) <> ''").select("src", "row_key", "text").mapInArrow(_labeller(net), "src string, row_key string, lang string, confidence double")


def labelled_sample(pages: DataFrame, docs: DataFrame, per_language: int = PAGES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` pages of each language the catalog names, chosen by a hash."""
    named = pages.where("trim(text) <> ''").join(docs.withColumn("code", F.lower(F.trim("language"))).where(F.col("code").isin(*LANGUAGES)).select("document_id", "code"), "document_id")
    w = Window.partitionBy("code").orderBy(F.xxhash64("row_key"), "row_key")
    top = named.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language)
    return sorted((r["code"], r["text"]) for r in top.select("code", "text").collect())


def segments(texts: DataFrame, net: ByteNetwork) -> DataFrame:
    """Segments of ``src, row_key, text``: ``seg_no`` from 1, ``lang``, first and last sentence, ``confidence``.

    Null and blank texts, and those of fewer than two sentences, have none. Repeated rows come out once per row given.
    """
    return texts.where("trim(text) <> ''").select("src", "row_key", "text").mapInArrow(_segmenter(net), "src string, row_key string, seg_no long, lang string, first_sentence int, last_sentence int, confidence double")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ByteNetwork]:
    """Pages with their document's language in the catalog, gold texts, and the network trained on the labelled pages."""
    docs = table(spark, sf_dir, "case_documents").select(F.col("id").alias("document_id"), "language").dropDuplicates(["document_id"])
    pages = rows_of(spark, sf_dir, "ocr_pages", "ocr_pages", "id", "text", F.col("document_id").cast("long")).dropDuplicates(["row_key"])
    gold = rows_of(spark, sf_dir, "gold_labels", "gold_labels", "id", "ocr_text").select("src", "row_key", "text", F.lit(None).cast("long").alias("document_id"))
    return union(pages, gold), docs, fit(labelled_sample(pages, docs))


def _with_catalog(found: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    catalog = texts.where("document_id is not null").select("src", "row_key", "document_id").join(docs, "document_id", "left").select("src", "row_key", F.nullif(F.lower(F.trim("language")), F.lit("")).alias("catalog"))
    return found.join(catalog, ["src", "row_key"], "left")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of pages and gold texts, with the catalog's language beside them."""
    texts, docs, net = _inputs(spark, sf_dir)
    return _with_catalog(segments(texts, net), texts, docs)


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language and confidence for each page and gold text, with the catalog's beside it."""
    texts, docs, net = _inputs(spark, sf_dir)
    return _with_catalog(languages(texts, net), texts, docs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("src", "row_key")
    found = p3_segments(spark, sf_dir).withColumn("n", F.count("*").over(w)).where((F.col("src") == "gold_labels") | F.col("catalog").isNull() | (F.col("n") > 1) | (F.col("lang") != F.col("catalog")))
    return found.select("src", "row_key", "seg_no", "lang")


def queries():
    return {"p3_found": p3_found, "p3_segments": p3_segments, "p3_languages": p3_languages}


def oracle_sql():
    return {}
