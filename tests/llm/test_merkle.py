"""The manifest against a plain version, for block sizes and fanouts, and on odd rows."""
import brute
import pytest

from rallygrid.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def same(df, fanout, block):
    got = [tuple(r) for r in merkle.proofs(df, fanout, block).collect()]
    want = brute.merkle([tuple(r) for r in df.select(*FIELDS).collect()], fanout)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("fanout, block", [(2, merkle.BLOCK), (2, 8), (2, 1), (3, 9), (5, 26)])
def test_proofs_equal_plain_version(docs, fanout, block):
    got = same(docs, fanout, block)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 33])
def test_last_subtrees_of_all_sizes(spark, n):
    same(spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string"), 2, 2)


def test_odd_rows(spark, nothing):
    """Nulls, repeated rows, ids with two texts, a long text, the largest count."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "a", "en", 1, "x"), (3, "a", "en", 1, "x"), (3, "a", "en", 2, "y"), (7, "a", "\u00e9", (1 << 63) - 1, "z" * 10 ** 6),
            (8, "", "", 0, ""), (21, "b", "en", None, "1:-")] + [(5, "s", "hot", 1, "same")] * 40
    got = same(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), 2, 4)
    assert len(got) == len(rows)
    assert merkle.proofs(nothing).count() == 0


def test_fields_do_not_run_together(spark):
    a, b = [merkle.document_leaves(spark.createDataFrame([r], "doc_id long, source string, lang string, n_chars long, text string")).first()["leaf"]
            for r in ((1, "ab", "c", 1, "t"), (1, "a", "bc", 1, "t"))]
    assert a != b
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], "group string, id long, leaf string, claimed string"), 1)
