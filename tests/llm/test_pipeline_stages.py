"""The stages of the pipeline on awkward columns and rows, against rules written here."""

import re

import pytest

import corpus_pipeline
from test_training_data import LONG, _sentence

CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, _found string, kept_id long, kept_hash long, judged string, spans string, "
    "redacted string, row string, size string, taken string, copy string, words string, id long, component_id long"
)
GOOD = ". ".join(_sentence(seed, 9).capitalize() for seed in range(12)) + "."
#: Of 150 shingles 1 in 6 is changed: likeness between 0.80 and 0.85.
BASE = [f"w{k}" for k in range(160)]
NEAR = " ".join("x" if k in (30, 80, 130) else w for k, w in enumerate(BASE))


def table(spark, rows):
    extra = ("f", 7, 8, "j", "s", "r", "o", "z", "t", "c", "w", 9, 10)
    return spark.createDataFrame([(i, t, "en", source, None, *extra) for i, t, source in rows], CLASHING)


ROWS = [
    (1, GOOD, "a"), (2, GOOD, "a"), (2, GOOD, "a"), (3, None, "a"), (4, "", None), (5, " \n ", "b"), (None, GOOD + " token: abcdefgh12345678", "b"),
    (6, LONG, "b"), (7, "too short", "c"), (8, "password = 'hunter2hunter2' " * 3 + GOOD, "c"), (None, None, None),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], table(spark, ROWS)
    found, none = stage(spark, docs, ""), stage(spark, table(spark, []), "")
    assert none.count() == 0 and none.columns == found.columns
    if name == "byte BPE":
        assert sorted(r.doc_id or 0 for r in found.collect()) == sorted(i or 0 for i, _, _ in ROWS)
        return
    assert found.dtypes == docs.dtypes
    rows = found.collect()
    assert rows and {tuple(r)[5:] for r in rows} == {("f", 7, 8, "j", "s", "r", "o", "z", "t", "c", "w", 9, 10)}
    if name != "near duplicates":  # which leaves texts as they are
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_quality_by_rules_written_here(spark):
    found = corpus_pipeline.quality(spark, table(spark, ROWS), "").collect()
    enough = [(i, t) for i, t, _ in ROWS if len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) >= 50]
    assert {r.doc_id for r in found} <= {i for i, _ in enough} and {1, 2} <= {r.doc_id for r in found}
    assert all(set(r.text.split("\n")) <= set(t.split("\n")) for r in found for i, t in enough if i == r.doc_id and i not in (None,))


def test_near_duplicates_from_80_percent(spark):
    a, b = {tuple(BASE[k : k + 5]) for k in range(156)}, {tuple(NEAR.split()[k : k + 5]) for k in range(156)}
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    rows = [(1, " ".join(BASE), "a"), (2, NEAR, "a"), (3, GOOD, "a")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()) == [1, 3]


def test_secrets_by_rules_written_here(spark):
    """Whatever the fixed patterns match is gone from the text, and texts without candidates stay as they are."""
    found = corpus_pipeline.secrets(spark, table(spark, ROWS), "").collect()
    assert len(found) == len(ROWS)
    assigned = re.compile(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}", re.ASCII)
    assert not any(assigned.search(r.text or "") for r in found)
    assert sum((r.text or "").count("<assign>") for r in found) == 4
    assert [r.text for r in found if r.doc_id == 1] == [GOOD]


def test_mix_by_words(spark):
    """No document comes more than three times; every word of the mix is a word of its document."""
    rows = [(k, _sentence(k, 20 + k), "abc"[k % 3]) for k in range(30)]
    found = corpus_pipeline.mix(spark, table(spark, rows), "").collect()
    texts = {i: t.split() for i, t, _ in rows}
    taken = {}
    for r in found:
        words = r.text.split()
        assert words == texts[r.doc_id][: len(words)]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words)
    assert all(n <= 3 * len(texts[i]) for i, n in taken.items())
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    shares = {s: sum(n for i, n in taken.items() if "abc"[i % 3] == s) for s in "abc"}
    # Weights 5, 2, 1 over all words; no source is asked for more than three times its size.
    total = sum(sizes.values())
    want = dict(zip("abc", (5 * total / 8, 2 * total / 8, total / 8)))
    assert all(want[s] <= 3 * sizes[s] and abs(shares[s] - want[s]) < 1 for s in "abc")
