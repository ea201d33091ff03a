import math
import time

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.llm import language


def test_address():
    assert language.address("https://u:p@A.B.Example.COM:80/x?y") == ("a.b.example.com", "example.com", "com")
    assert language.address("//host/x") == ("host", "host", "host") and language.address("no") == language.address("") == ("none", "none", "none")
    assert language.plain_text(b"<a><script>x</script>b<!-- c --><nav>d</nav>&amp;e").split() == [b"b", b"e"]


def test_pages(spark):
    read = lambda t: spark.read.parquet(str(DATA / f"sf0.01/{t}.parquet"))
    pages = read("pages")
    found = language.identify(pages, read("documents"))
    assert found.count() == pages.count()
    rows = found.join(pages, "page_id").collect()
    assert np.mean([r.lang == r.url.split("/")[3] for r in rows]) >= 0.99


def test_held_out_texts(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    model = language.TextModel(docs.filter("doc_id % 3 <> 0"))
    out = docs.filter("doc_id % 3 = 0").collect()
    texts = [r.text.encode() for r in out]
    scores, _ = model.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.mean([model.languages[i] == r.lang for i, r in zip(scores.argmax(1), out)]) >= 0.97


def test_counts_are_those_of_all_texts(spark):
    texts = [("a", "Abc abc 12"), ("a", ""), ("b", "xyz é"), (None, "zzz"), ("b", None)]
    model = language.TextModel(spark.createDataFrame(texts, "lang string, text string"))
    assert model.languages == ["a", "b"]
    for lang, text in (("a", "Abc abc 12"), ("b", "xyz é")):
        raw = text.encode()
        bucket, _ = language.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        counts = np.bincount(bucket, minlength=language.BUCKETS) + 0.5
        assert np.allclose(model.logs[model.languages.index(lang)], np.log(counts / counts.sum()), atol=1e-5)


def test_evidence_decides(spark):
    """Without text the markup and the host decide; missing values are no error."""
    docs = spark.createDataFrame([("en", "the cat and the dog " * 20), ("de", "der hund und die katze " * 20)] * 3, "lang string, text string")
    page = lambda i, lang, host, text: (i, f"http://{host}/x", f'<html lang="{lang}"><body>{text}</body></html>', "s", 1)
    rows = [page(i, "en", "a.example.com", "the cat and the dog") for i in range(20)] + [page(50 + i, "de", "b.example.org", "der hund und die katze") for i in range(20)]
    rows += [page(100, "de", "b.example.org", ""), page(101, "en", "a.example.com", "zz"), (102, None, None, "s", 1), (None, "x", "", "s", 1), (103, "http://b.example.org/", "<p>", "s", 1), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, scores string, p int")
    found = {r.page_id: r for r in language.identify(df, docs).collect()}
    assert (found[100].lang, found[101].lang, found[103].lang) == ("de", "en", "de") and None in found and found[102].declared == "none"
    assert all(r.lang == "en" for i, r in found.items() if i is not None and i < 20)
    assert language.identify(df, docs.limit(0)).count() == len(rows) and language.identify(df.limit(0), docs).collect() == []


def test_malformed_pages_take_linear_time():
    """Tags, elements and comments without an end, ten megabytes of them."""
    for start in (b"<script ", b"<script>", b"<!-- ", b"<", b"<nav><style>", b"</script", b"<html ", b"&amp", b"<!--<script>"):
        page = start * (10_000_000 // len(start))
        began = time.process_time()
        language.plain_text(page)
        language.declared(page)
        assert time.process_time() - began < 1, start
    assert language.plain_text(b"<p>a<script>b</p>c<nav>d</nav >e<!-- f").split() == [b"a", b"b", b"c", b"e<!--", b"f"]
    assert language.plain_text(b"a<!--b-->c<SCRIPT x>d</Script>e<scripted>f&lt;g").split() == [b"a", b"c", b"e", b"f", b"g"]


def slowly(seen, n):
    """The fusion written out: page_id to its posteriors."""
    out = {}
    sums = lambda rows, i: sum(r.p[i] for r in rows)
    for r in seen:
        rest = [x for x in seen if x is not r]
        same = {k: [x for x in rest if x[k] == r[k]] for k in ("declared", "suffix", "site", "host")}
        score = []
        for i in range(n):
            prior = (sums(rest, i) + language.ALPHA) / (len(rest) + language.ALPHA * n)
            site = (sums(same["site"], i) + language.SITE_WEIGHT * prior) / (len(same["site"]) + language.SITE_WEIGHT)
            host = (sums(same["host"], i) + language.HOST_WEIGHT * site) / (len(same["host"]) + language.HOST_WEIGHT)
            score.append(r.scores[i] + math.log(host))
            for k in ("declared", "suffix"):
                score[-1] += math.log((sums(same[k], i) + language.ALPHA) / (sums(rest, i) + language.ALPHA * len({x[k] for x in seen})))
        p = np.exp(np.array(score) - max(score))
        out[r.page_id] = p / p.sum()
    return out


def test_fusion_by_brute_force(spark):
    read = lambda t: spark.read.parquet(str(DATA / f"sf0.001/{t}.parquet"))
    pages, model = read("pages"), language.TextModel(read("documents"))
    rows = pages.select("page_id", "url", F.col("html"))
    seen = rows.mapInArrow(language._evidence(model), "page_id long, declared string, host string, site string, suffix string, scores array<double>, p array<double>").collect()
    due = slowly(seen, len(model.languages))
    for r in language.identify(pages, read("documents")).collect():
        assert abs(r.confidence - due[r.page_id].max()) < 1e-5 and due[r.page_id][model.languages.index(r.lang)] >= due[r.page_id].max() - 1e-9


def test_declared_behind_a_long_start(spark):
    """The html tag counts wherever it stands."""
    start = "<!-- " + "x " * 40_000 + "-->"
    assert language.declared(b"<html><HTML class=a LANG = 'De-x'>") == "de" and language.declared(b"<html lang") == language.declared(b"") == "none"
    assert language.declared(b"<html " * 100_000) == "none"
    df = spark.createDataFrame([(1, "http://a.b/", start + '<html lang="fr"><body>a</body>')], "page_id long, url string, html string")
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien")], "lang string, text string")
    assert language.identify(df, docs).first().declared == "fr"


def test_all_languages(spark, monkeypatch):
    """However many languages the labels hold, all are told apart; posteriors summed as rows give the same."""
    made = {f"l{i:03}": " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "qxzjkvwy") for i in range(230)}
    docs = spark.createDataFrame([(lang, text * (2 if lang < "l220" else 1)) for lang, text in made.items()], "lang string, text string")
    assert language.TextModel(docs).languages == sorted(made)
    df = spark.createDataFrame([(i, f"http://h{i}.x/", f"<html><body>{made[lang]} {made[lang]}") for i, lang in ((1, "l003"), (2, "l225"), (3, "l229"))], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in language.identify(df, docs).collect()} == {1: "l003", 2: "l225", 3: "l229"}
    few = docs.filter("lang < 'l010' OR lang > 'l224'")
    as_columns = sorted(language.identify(df, few).collect())
    monkeypatch.setattr(language, "COLUMNS", 3)
    assert sorted(language.identify(df, few).collect()) == as_columns
