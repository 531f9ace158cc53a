"""Personal data, licences, pages, fingerprints, neighbours and quality against plain versions on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.llm import imatch, licences, nearest, pages, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# ---- personal data

def plain_base(text):
    """The patterns as they are written, match by match."""
    def luhn(d):
        odd = [int(c) for c in reversed(d)]
        return (sum(odd[::2]) + sum(x * 2 - 9 * (x > 4) for x in odd[1::2])) % 10 == 0
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "..", "1.2.3.4", "256.1.1.1", "0255.1.1.09", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 010-9999", "+", "é", "x", "7", "9.9.9.9.9.9.9.9",
            "_", "%", "+49 30 1234567", "a.b@c-d.e.f", "@x.y", "\n", "55", "4242-4242-4242-4242-4"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.find(t)[0] == plain_base(t), t


def test_long_runs_are_quick():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 200_000, "a@" * 100_000, "+1" + ")" * 200_000, "A1" * 100_000):
        pii.find(t)


def test_more_spans_and_scores():
    t = "IBAN DE89 3704 0044 0532 0130 00 BIC X, ssn 123-45-6789, order 123-45-6789, call 030 1234567, card 4111 1111 1111 1111"
    base, both = pii.find(t)
    kinds = [s[2] for s in both]
    assert "iban" in kinds and kinds.count("ssn") == 1 and "tel" in kinds and set(base) <= {s[:3] for s in both}
    assert t[next(s for s in both if s[2] == "iban")[0]:][:27] == "DE89 3704 0044 0532 0130 00"
    alone = [s[3] for s in pii.find("4111 1111 1111 1111")[1]]
    assert alone and alone[0] < next(s[3] for s in both if s[2] == "card")
    assert pii.find("id DE88 3704 0044 0532 0130 00 here")[1] == []   # checksum fails


def test_personal_data_rows(spark):
    rows = pii.personal_data(docs(spark, [None, "", "ä a@b.de 10.0.0.1", "ä a@b.de 10.0.0.1"]).withColumn("spans", F.lit(1))).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["", "", "email:2:8,ip:9:17", "email:2:8,ip:9:17"]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].base_sha256 == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert pii.personal_data(docs(spark, []).limit(0)).count() == 0


# ---- licences

def test_base_phrases_and_templates(spark):
    texts = [None, "", "The MIT  License\n(mit-license) CC BY, cc/by", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "pre " * 50 + "Permission is hereby granted, free of charge, to any one obtaining a copy of this software and the associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it",
             "plain words only", "gnu general public  licence", "MIT\xc4license", "apache license " * 3000]
    rows = licences.licences(docs(spark, texts).withColumn("labels", F.lit(0))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        starts = [(i, lab) for p, lab in licences.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert r.first_word == min((i for i, _ in starts), default=None) and r.last_word == max((i for i, _ in starts), default=None)
        assert r.base_labels == ",".join(sorted({lab for _, lab in starts}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "cc-by-nc-4.0" in rows[3].labels and "gpl-3.0" in rows[4].labels and "mit" in rows[5].labels and rows[6].labels == ""


# ---- pages

ARTICLE = "<article><h1>Title {i} &amp; more</h1><p>One {i}.<br>\n two<p>Three  {i}.</p><aside>no</aside><section id='comments'><p>no</p></section></article>"
PLAIN = "<div class='wrap'><div class='lead'>Follow our channel</div><div class='body-copy'><p>{a}</p><p>{b}</p></div><div class='bottom'>All rights kept</div></div>"


def test_article_pages(spark):
    shell = "<html><head><title>t</title><script>var t='</p>'</script></head><body><nav><a>m</a></nav><!-- x --><div class=ad>buy</div>{}<form>f</form><footer>&copy;</footer>"
    rows = [(i, f"http://h{i % 2}.org/{i}", shell.format(ARTICLE.format(i=i)), 1) for i in range(20)] + [(90, None, None, 1), (91, "x", "", 1), (92, "http://h0.org/", "a < b & c", 1), (92, "http://h0.org/", "a < b & c", 1)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(20):
        assert got[i] == f"Title {i} & more\nOne {i}. two\nThree {i}."
    assert got[90] == "" and got[91] == "" and got[92] == "a < b & c"
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_words_go_where_no_article_is_marked(spark):
    rng = random.Random(5)
    word = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(30))
    body = [(word(), word()) for _ in range(12)]
    rows = [(i, "https://plain.net/p", "<body>" + PLAIN.format(a=a, b=b)) for i, (a, b) in enumerate(body)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{a}\n{b}" for i, (a, b) in enumerate(body)}


# ---- document fingerprints

def test_next_documents_and_fingerprints(spark):
    rng = random.Random(6)
    vocab = [f"term{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) + "é\U0001f600" for _ in range(60)] + [None, "", "same text", "same text"]
    df = docs(spark, texts).withColumn("doc_id", F.col("doc_id") * 7 - 100)
    rows = imatch.fingerprints(df.withColumn("sha", F.lit("x")), low=0.02, ranges=8).orderBy(F.desc("doc_id")).collect()
    order = [t or "" for t in reversed(texts)]
    assert len(rows) == len(order)
    for k, (r, t) in enumerate(zip(rows, order)):
        nxt = order[(k + 1) % len(order)]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (edited != t or (r.near_edited == 1 and r.fingerprint == r.edited_fingerprint))
    same = [r.fingerprint for r, t in zip(rows, order) if t == "same text"]
    assert len(set(same)) == 1
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows])
    one = imatch.fingerprints(docs(spark, ["alone here"])).collect()
    assert one[0].near_next == 1.0 and imatch.fingerprints(docs(spark, ["x"]).limit(0)).count() == 0


# ---- nearest neighbours

@pytest.mark.parametrize("dim,kind", [(7, "float"), (130, "double")])
def test_neighbours_equal_brute_force(spark, dim, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, dim)).astype("float32" if kind == "float" else "float64")
    x[100:140], x[200:210] = x[100], -x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1050, []), (1051, [0.0] * dim), (1052, [float("nan")] * dim), (1053, [None] + [1.0] * (dim - 1)), (1100, [float("inf")] * dim), (None, [1.0] * dim), (1150, [1.0, 2.0])] + rows[:3]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = [tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 50 == 0, candidates=150, queries=6).collect()]
    d = x.astype("float64")
    want = []
    for q in range(0, 700, 50):
        s = [(-min(1.0, max(-1.0, float(nearest.cosine(d[q:q + 1], d[c:c + 1])[0]))), c) for c in range(700) if c != q]
        want += [(q, k + 1, c, -v) for k, (v, c) in enumerate(sorted(s)[:5])]
    assert sorted(got) == sorted(want)
    few = nearest.nearest(df.filter("vec_id < 3"), F.col("vec_id") == 0).count()
    assert few == 2 and nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_cosine_beyond_the_range_of_squares():
    a = np.array([[1e-200, 2e-200], [1e200, 1e200], [3.0, 4.0]])
    assert np.allclose(nearest.cosine(a, a[:, ::-1].copy()), [0.8, 1.0, 0.96])


# ---- quality

def test_terms_are_whole_and_scores_sane(spark):
    s = quality.Settings(sample=100, epochs=6)
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "light", "meadow", "walking"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "xx||xx"]) for _ in range(60)) for _ in range(60)]
    df = docs(spark, good + bad + [None, "", " "])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, s)
    rows = quality.scored(df.withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert min(r.score for r in rows[:60]) > max(r.score for r in rows[60:120])
    assert rows[120].score == rows[121].score == rows[122].score
    assert len(quality.fit(df, labels.limit(0), s).vectors) == 1 << s.bits and quality.scored(df.limit(0), model).count() == 0
    long_text = " ".join(good) * 40
    at, share = quality._counts(long_text, s)
    assert abs(share.sum() - 1) < 1e-3 and 0 < model.scorer()(long_text) < 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(df, labels)
    told = (quality.scored(df.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))), model)
            .select("quality", (F.col("score") >= 0.3).cast("int").alias("p")).collect())
    kept = [r.p for r in told if r.quality == 1]
    gone = [1 - r.p for r in told if r.quality == 0]
    assert len(told) > 500 and sum(kept) / len(kept) > 0.97 and sum(gone) / len(gone) > 0.8


def test_examples_wait_packed(spark):
    text = " ".join(f"word{k % 900} and{k % 7}" for k in range(4000))
    at, share = quality._counts(text, quality.Settings())
    packed = quality._packed(at, share)
    a, b = quality._opened(packed)
    assert (a == at).all() and a.dtype == at.dtype and (b == share.astype("float64")).all()
    assert len(packed) < (at.nbytes + share.nbytes) / 2
    none = quality._opened(quality._packed(*quality._counts("", quality.Settings())))
    assert [len(x) for x in none] == [0, 0]
