"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are added in log space for each language l:

    text        log P(text | l): naive Bayes over byte trigrams, counted over all labelled documents, tempered, since
                neighbouring trigrams are not independent;
    markup      log P(declared language | l): from the html element's lang attribute;
    address     log P(address suffix | l): the last label of the host name;
    host        log P(l | host): a prior smoothed along the hierarchy all pages -> site -> host.

The tables of markup, address and host come from grouped aggregation over all pages of the text's own posteriors
(soft counts, partially aggregated before any shuffle), and a page's own share is taken out of all of them. Only the trigram counts (at most BUCKETS a language, only those that occur) and the evidence tables of languages go to the driver.

Defined results: null html, url or lang count as missing; missing markup or address is evidence of its own kind
("none" is a value like any other); a page without text is decided by the rest; ties go to the first language in code
point order; without labelled documents the language is null and the confidence 0; repeated rows count as pages of
their own; rows without an id are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, pieces, table, utf8

BUCKETS = 1 << 15
#: With more languages than this, posteriors are summed as rows, not as columns. All languages are told apart.
COLUMNS = 200
#: Weight of a trigram, and the most the text counts for, in trigrams.
TEMPER, TEXT_LIMIT = 0.1, 200
ALPHA, SITE_WEIGHT, HOST_WEIGHT = 0.5, 20.0, 20.0

# Letters in lower case, digits as one, other ASCII characters as blanks, other bytes as they are.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 for c in range(256)], np.uint32)
_TAG, _ENTITY = re.compile(rb"<[^>]*>"), re.compile(rb"&#?\w{1,12};")
#: Elements left out with what stands in them, and how each ends; comments likewise.
_ENDS = {name: re.compile(rb"(?i)</%s\s*>" % name) for name in (b"script", b"style", b"nav", b"noscript", b"template")} | {b"!--": re.compile(rb"-->")}
_HTML = re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"""(?i)\blang\s*=\s*["']?([a-z]{2,8})""")
_HOST = re.compile(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)")


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that don't begin with two blanks or cross texts, and each one's text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f = _FOLD[data]
    mixed = (f[:-2] * np.uint32(0x01000193) ^ f[1:-1]) * np.uint32(0x01000193) ^ f[2:]
    mixed = mixed * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = (text[:-2] == text[2:]) & ((f[:-2] != 32) | (f[1:-1] != 32))
    return mixed[keep].astype(np.int64), text[:-2][keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, text) to counts, one row for each language and bucket a partition has."""
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in pieces(batches):
        coded = batch.column(0).dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bucket, text = trigrams(*utf8(batch.column(1)))
        order = np.argsort(code[text], kind="stable")
        edges = np.searchsorted(code[text][order], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            own = np.bincount(bucket[order[edges[i] : edges[i + 1]]], minlength=BUCKETS)
            held[name] = held[name] + own if name in held else own
            if len(held) > 64:
                yield from out()
    yield from out()


class TextModel:
    """languages, and by language the buckets that occur, their log-likelihoods, and that of all other buckets."""

    def __init__(self, documents: DataFrame):
        named = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
        counts = named.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        rows = cut(counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), "n"))).alias("all")).select("lang", "all.bucket", "all.n")).toArrow()
        found = {}
        for lang, bucket, n in zip(rows["lang"].to_pylist(), rows["bucket"], rows["n"]):
            smooth = n.values.to_numpy() + 0.5
            total = smooth.sum() + 0.5 * (BUCKETS - len(smooth))
            found[lang] = bucket.values.to_numpy(), np.log(smooth / total).astype(np.float32), np.float32(np.log(0.5 / total))
        self.languages = sorted(found)
        self.sparse = [found[lang] for lang in self.languages]

    def dense(self, i: int) -> np.ndarray:
        """Log-likelihoods of all buckets in a language."""
        bucket, logs, rest = self.sparse[i]
        own = np.full(BUCKETS, rest, np.float32)
        own[bucket] = logs
        return own

    @property
    def logs(self) -> np.ndarray:
        """Log-likelihoods, languages by BUCKETS."""
        return np.stack([self.dense(i) for i in range(len(self.sparse))]) if self.sparse else np.zeros((0, BUCKETS), np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods, texts by languages, and each text's number of trigrams."""
        bucket, text = trigrams(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(text, minlength=n)
        sums = np.stack([np.bincount(text, self.dense(i)[bucket], n) for i in range(len(self.sparse))], axis=1) if self.sparse else np.zeros((n, 0))
        return sums * (TEMPER * np.minimum(count, TEXT_LIMIT) / np.maximum(count, 1))[:, None], count


@functools.cache
def _starts(names: frozenset[bytes]) -> re.Pattern[bytes]:
    named = b"|".join(sorted(n for n in names if n != b"!--")) or b"(?!)"
    comment = b"|(!--)" if b"!--" in names else b""
    return re.compile(rb"(?i)<(?:(%s)\b%s)" % (named, comment))


def plain_text(html: bytes) -> bytes:
    """Text without left-out elements, comments, tags and entities. A kind whose end is missing once is not sought again, so time is linear."""
    kept, at, begin, open_ = [], 0, 0, frozenset(_ENDS)
    while open_ and (start := _starts(open_).search(html, at)):
        name = (start[1] or b"!--").lower()
        if end := _ENDS[name].search(html, start.end()):
            kept.append(html[begin : start.start()])
            at = begin = end.end()
        else:
            at, open_ = start.start(), open_ - {name}
    text = b" ".join([*kept, html[begin:]])
    last = text.rfind(b">") + 1
    return _ENTITY.sub(b" ", _TAG.sub(b" ", text[:last]) + text[last:])


def declared(html: bytes) -> str:
    """The lang attribute of the first html tag that has one, wherever it stands; "none" without any. Each byte is read once."""
    at = 0
    while tag := _HTML.search(html, at):
        at = html.find(b">", tag.end())
        at = len(html) if at < 0 else at
        if found := _LANG.search(html, tag.end(), at):
            return found[1].decode().lower()
    return "none"


def address(url: str) -> tuple[str, str, str]:
    """Host, site (its last two labels) and suffix of an address; "none" where there is none."""
    m = _HOST.match(url)
    if not m:
        return "none", "none", "none"
    host = m[1].lower().rstrip(".") or "none"
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def _evidence(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            pages = batch.column(2)
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in pages]
            texts = [plain_text(x) for x in raw]
            found = [declared(x) for x in raw]
            places = [address(u or "") for u in batch.column(1).to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            scores, _ = model.score(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
            p = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf)) if scores.shape[1] else scores
            p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float64())) for x in (scores, p)]
            columns = [batch.column(0), pa.array(found, pa.string()), *(pa.array([x[i] for x in places], pa.string()) for i in range(3)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "declared", "host", "site", "suffix", "scores", "p"])

    return run


def _soft(seen: DataFrame, kind: str, n: int) -> DataFrame:
    """kind, soft, pages: sums of the posteriors by language, as exact decimals: the same in any order and either way."""
    exact = lambda p: F.sum(p.cast("decimal(30,9)")).cast("double")
    pages = F.count("*").cast("double").alias("pages")
    if n <= COLUMNS:
        return seen.groupBy(kind).agg(F.array(*(exact(F.get("p", F.lit(i))) for i in range(n))).alias("soft"), pages)
    # Posteriors under half a unit of the decimals' last place count as 0 in either way.
    parts = seen.select(kind, F.posexplode("p").alias("i", "v")).filter("v >= 4e-10").groupBy(kind, "i").agg(exact(F.col("v")).alias("v"))
    known = parts.groupBy(kind).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("sums"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("sums", i), F.lit(0.0)))
    return seen.groupBy(kind).agg(pages).join(known, kind, "left").select(kind, filled.alias("soft"), "pages")


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang (by text alone), declared, host of every page."""
    model = TextModel(documents)
    n = len(model.languages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = cut(rows.mapInArrow(_evidence(model), "page_id long, declared string, host string, site string, suffix string, scores array<double>, p array<double>"))
    if not n:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    whole = _soft(seen.withColumn("every", F.lit(0)), "every", n).first()
    soft, every = ([v or 0.0 for v in whole["soft"]], whole["pages"]) if whole else ([0.0] * n, 1.0)
    total = F.array(*(F.lit(float(x)) for x in soft))
    joined, values = seen, {}
    for kind in ("declared", "suffix", "site", "host"):
        counts = _soft(seen, kind, n).select(kind, F.col("soft").alias(f"{kind}_soft"), F.col("pages").alias(f"{kind}_pages"))
        values[kind] = counts.count() if kind in ("declared", "suffix") else 0
        joined = joined.join(counts, kind)

    def posterior(i: Column) -> Column:
        """Sum of the evidence for language i; the page's own share is in no table."""
        own = F.get("p", i)
        less = lambda c: F.greatest(F.get(c, i) - own, F.lit(0.0))
        prior = (less(total) + ALPHA) / F.lit(every - 1 + ALPHA * n)
        site = (less("site_soft") + SITE_WEIGHT * prior) / (F.col("site_pages") - 1 + SITE_WEIGHT)
        host = (less("host_soft") + HOST_WEIGHT * site) / (F.col("host_pages") - 1 + HOST_WEIGHT)
        seen_as = lambda kind: F.log((less(f"{kind}_soft") + ALPHA) / (less(total) + ALPHA * values[kind]))
        return F.get("scores", i) + seen_as("declared") + seen_as("suffix") + F.log(host)

    names = F.array(*map(F.lit, model.languages))
    first = lambda values: F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)
    fused = joined.withColumn("sum", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), posterior))
    mass = F.aggregate(F.transform("sum", lambda v: F.exp(v - F.array_max("sum"))), F.lit(0.0), lambda a, b: a + b)
    return fused.select("page_id", first(F.col("sum")).alias("lang"), F.round(1 / mass, 6).alias("confidence"), first(F.col("scores")).alias("text_lang"), "declared", "host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


SQL = None
