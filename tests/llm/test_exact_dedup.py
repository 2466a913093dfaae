from hashlib import sha256

from quern.llm.exact_dedup import drop_exact_duplicates, exact_dedup

SCHEMA = "doc_id long, text string, kept string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    texts = ["Hot text"] * 300 + ["hot TEXT"] * 50 + ["É", "é", "", None, "a", "A", "b" * 100_000]
    return [(i, t, f"k{i}", "s") for i, t in enumerate(texts)]


def brute(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {i: (max(m), len(m), i == max(m), sha256(t.encode()).hexdigest()) for t, m in groups.items() for i in m}


def test_against_brute_force_with_and_without_heavy_hitters(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    for track, top in ((1_024, 1), (16_384, 4_096)):
        found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, track=track, top=top).collect()}
        assert found == brute(data)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x", "k", "s")] * 3 + [(None, "x", "k", "s"), (None, "y", "k", "s")], SCHEMA)
    found = exact_dedup(df).collect()
    assert len(found) == 5
    assert sum(r.kept for r in found) == 2
    assert {r.keep_id for r in found} == {1, None}
    assert sorted(r.group_size for r in found) == [1, 4, 4, 4, 4]


def test_drop_keeps_one_row_of_each_text_with_its_columns(spark):
    data = rows()
    df = spark.createDataFrame([*data, data[0], data[349]], SCHEMA)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.kept) for r in kept.collect()) == sorted((i, f"k{i}") for i, x in brute(data).items() if x[2])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).collect() == [] and drop_exact_duplicates(df).collect() == []
