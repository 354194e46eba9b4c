"""Token counts, whitening and importance resampling against brute force, and scans that must not hang."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html_extract, importance, secret_scan, token_counts, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, row string, score string, rank string"


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéßAZ09") for _ in range(rng.randrange(1, 7))) for _ in range(n))


ROWS = [
    (1, _text(1, 30)), (2, _text(1, 30)), (3, None), (4, ""), (5, " \n\t "), (6, _text(2, 4000)), (6, _text(2, 4000)), (6, _text(3, 25)),
    (None, _text(4, 40)), (None, _text(5, 22)), (None, None), (7, "aa" * 3000), (8, "日本語🙂\x00▁" * 400), (9, "one two"), (10, "<s> x </s> <unk>"),
    (11, "=" * 5000 + "  " * 300), (12, _text(1, 30) + " Z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", "s", "k") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def _same(left, right):
    assert sorted(map(tuple, left), key=_key) == sorted(map(tuple, right), key=_key)


# Token counts


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 128), (512, 64), (40, 3)])
def test_token_counts(spark, docs, library, chunk, overlap):
    counted = token_counts.count_tokens(docs, model=MODEL, chunk=chunk, overlap=overlap)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"]
    _same(counted.collect(), [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS])
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), model=MODEL).count() == 0


def test_overlaps_widen_until_they_agree(spark, docs, library, monkeypatch):
    """Where no common token is accepted, documents are counted as a whole in the end."""
    rounds = []
    summary = token_counts._summary
    monkeypatch.setattr(token_counts, "_summary", lambda model, chunk, overlap: rounds.append((chunk, overlap)) or summary(model, chunk, overlap))
    counted = token_counts.count_tokens(docs, model=MODEL, chunk=30, overlap=1)
    _same(counted.collect(), [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS])
    assert rounds[:2] == [(30, 1), (120, 4)] and len(rounds) > 2


@given(st.text(max_size=60) | st.text("ab =-\n▁ae日🙂", max_size=120), st.integers(2, 30), st.integers(1, 2))
@settings(max_examples=300, deadline=None)
def test_spliced_chunks_are_the_encoding(library, text, chunk, part):
    """Whatever the chunks, a splice at a common token gives the token starts of the whole text."""
    counter = token_counts.counter(MODEL)
    overlap = max(1, chunk // part)
    text = counter.ahead + text if text else ""
    whole = counter.starts(text).tolist()
    left, right = counter.starts(text[: chunk + overlap]), counter.starts(text[chunk:])
    here = token_counts.common_token(left[left >= chunk] - chunk, right[right < overlap])
    if here is not None:
        assert left[left < chunk + here].tolist() + (right[right >= here] + chunk).tolist() == whole
    assert len(whole) == len(library.encode(text[1:]))


def test_models_that_change_the_text_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as fields

    told = fields.ModelProto.FromString(open(MODEL, "rb").read())
    told.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        token_counts.Counter(told.SerializeToString())


# Whitening


def _whitened_by_brute_force(vectors, components=4):
    usable = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * c) for c in v] for v in usable]
    distinct = sorted(set(map(tuple, x)))
    n, d = len(distinct), len(x[0])
    sums = [sum(v[k] for v in distinct) for k in range(d)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in distinct), n**3) for j in range(d)] for i in range(d)]
    values, basis = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    order = np.argsort(values)[::-1][:components]
    return x, n, sums, values[order], basis[:, order], float(sum(cov[k][k] for k in range(d)))


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).astype(np.float32).tolist() for _ in range(300)]
    vectors += [vectors[0]] * 150 + [[5.0, -7.5, 0.0, 1e-9, -1e-9, 3.0], [0.001] * 6, [0.002] * 6]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0]]
    rows = [(k if k % 7 else None, v, "c", 1) for k, v in enumerate(vectors)] + [(1000 + k, v, "c", 1) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int").repartition(5)
    got = whitening.whiten(df).collect()
    x, n, sums, values, basis, trace = _whitened_by_brute_force([[float(np.float32(c)) for c in v] for v in vectors])
    assert len(got) == 4 * len(vectors) and {r["n"] for r in got} == {n} == {len({tuple(v) for v in x})}
    want = Counter((r[0], sum((n * c - s) ** 2 for c, s in zip(v, sums))) for r, v in zip(rows, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    at = {(r["deviation"], r["component"]): r for r in got}
    for k in range(4):
        expected = (np.array(x) - np.array(sums) / n) @ basis[:, k] / math.sqrt(values[k])
        found = np.array([at[sum((n * c - s) ** 2 for c, s in zip(v, sums)), k + 1]["whitened"] for v in x])
        assert min(abs(found - expected).max(), abs(found + expected).max()) < 1e-9
        assert at[want.most_common(1)[0][0][1], k + 1]["explained"] == pytest.approx(values[k] / trace, rel=1e-9)


@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=150))
@settings(max_examples=60, deadline=None)
def test_counters_of_bit_planes_are_the_exact_sums(rows):
    """Whatever the range of the entries, weighted counts of common ones are the cross-products."""
    x = np.array(rows, np.int64)
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    planes = whitening.Planes(tuple(low), tuple((b - a).bit_length() for a, b in zip(low, high)))
    if not planes.bits or not max(planes.bits):
        planes = whitening.Planes(tuple(low), (1, 0, 0))
    counters = whitening.Counters(planes)
    for at in range(0, len(x), 70):
        counters.add(x[at : at + 70])
    out = counters.rows_out()
    n, sums, products = whitening.exact_sums(low, list(zip(*[out.column(c).to_pylist() for c in ("i", "j", "shift", "ones")])))
    assert n == len(rows) and sums == [sum(r[k] for r in rows) for k in range(3)]
    assert products == {(i, j): sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(i, 3)}


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 3 + [[3.0, 2.0]], [[1e300, -1e300, 1.0], [0.0, 1.0, 2.0]]])
def test_whitening_of_few_vectors(spark, vectors):
    """Components without variance are zero; deviations beyond a long are null."""
    got = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    usable = [v for v in vectors if v]
    assert len(got) == sum(min(4, len(v)) for v in usable)
    assert all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in got)
    if vectors and vectors[-1] == [3.0, 2.0]:
        first = [r for r in got if r["component"] == 1]
        assert sorted({abs(r["whitened"]) for r in first}) == [1.0] and {r["explained"] for r in first} == {1.0}
        assert {(r["whitened"], r["explained"]) for r in got if r["component"] == 2} == {(0.0, 0.0)}


# Importance resampling


_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text, longest=1):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOW))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def _resampled(rows, target, percent, min_words, buckets, longest):
    def counted(texts):
        found = Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in _features(t, longest)[1])
        return found, sum(found.values())

    (s, s_all), (t, t_all) = counted(x for _, x in rows), counted(target)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets)))) for k in range(buckets)]
    out = []
    for i, text in rows:
        words, found = _features(text, longest)
        weight = math.floor(Fraction(sum(gain[zlib.crc32(f.encode()) % buckets] for f in found), len(found))) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return Counter(r[:4] for r in out), [r[:4] for r in drawn]


@pytest.mark.parametrize(("percent", "min_words", "longest"), [(10, 20, 1), (50, 1, 2), (100, 0, 1), (0, 20, 1), (30, 0, 3)])
def test_importance_resampling(spark, docs, percent, min_words, longest):
    target = [_text(3, 25), None, "one Two two"]
    rows = [(i, t) for i, t in ROWS for _ in range(3)]
    df = docs.withColumn("k", F.expr("explode(sequence(1, 3))")).repartition(4)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(df, bench, percent=percent, min_words=min_words, buckets=50, longest=longest).collect()
    every, drawn = _resampled(rows, target, percent, min_words, 50, longest)
    assert Counter(tuple(r)[:4] for r in got) == every
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_importance_of_empty_tables(spark, docs):
    none, empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, empty).count() == len(ROWS)


@given(st.lists(st.integers(-6, 6), min_size=1, max_size=40), st.data())
@settings(max_examples=15, deadline=None)
def test_cutoff_takes_exactly_as_many_rows(spark, scores, data):
    wanted = data.draw(st.integers(0, len(scores)))
    df = spark.createDataFrame([(s, k % 3, k) for k, s in enumerate(scores)], "score long, down long, row long").coalesce(1)
    chosen = importance.highest(df, wanted, ["score", "down", "row"])
    got = sorted(tuple(r) for r in df.where(chosen).collect()) if chosen is not None else []
    assert got == sorted(sorted(((s, k % 3, k) for k, s in enumerate(scores)), reverse=True)[:wanted])


# Scans that must not hang, and attributes by name


@pytest.mark.parametrize("text", ["-" * 10_000 + "1", "ab/c_" * 20_000 + "2024", "=" * 100_000 + "x9", "a-" * 50_000 + "7"])
def test_separator_runs_take_linear_time(text):
    start = time.perf_counter()
    assert secret_scan.secret_spans(text) == []
    assert time.perf_counter() - start < 5


def test_clashing_columns_of_a_scan(spark):
    df = spark.createDataFrame([(1, "AKIA" + "A1" * 8, 5, "s", "r")], "doc_id long, text string, _found int, spans string, redacted string")
    (row,) = secret_scan.scan_secrets(df, carry=["_found", "text"]).collect()
    assert row["_found"] == 5 and row["redacted"] == "<access>" and [s["kind"] for s in row["spans"]] == ["access"]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<article title="The hidden valley">a b</article>', "a b"),
        ('<section aria-label="what is hidden here">x y</section>', "x y"),
        ('<article>go <a title="all hidden gems">here</a></article>', "go here"),
        ("<article>x<p hidden>no</p><p aria-hidden='true'>no</p><p style='color:red; display:none'>no</p><p HIDDEN=''>no</p>y</article>", "x y"),
        ("<article>x</article><form/>email field</form>", "x"),
        ("<article>a b</article><div class=sidebar/>links</div>", "a b"),
        ("<article>a<br/>b<img src=x/ alt='>'>c</article>", "a bc"),
        ("<article><p data-hidden='1' data-class='menu'>a</p><p class='x' class='menu'>b</p></article>", "a b"),
        ("<article>a <b don't>c</b> d</article>", "a c d"),
        ('<article>a b</article><a title="', "a b"),
    ],
)
def test_attributes_are_read_by_name(page, expected):
    marked, rest = html_extract.parse(page)
    assert " ".join(rest if marked is None else marked) == expected


def test_unclosed_tags_take_linear_time():
    start = time.perf_counter()
    html_extract.parse('<a "' * 100_000)
    html_extract.parse("<script '" * 100_000)
    assert time.perf_counter() - start < 5
