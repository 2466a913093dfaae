import math

from quern.llm.mix_sources import OP3_SQL, mix_sources, source_quotas

SCHEMA = "doc_id long, text string, source string, block int"


def rows():
    out = [(i, "w " * (1 + i % 7), "big", 0) for i in range(600)]
    out += [(1_000 + i, "w " * 5, "small", 0) for i in range(20)]
    return out + [(2_000, None, None, 0), (2_001, "a b c", None, 0), (2_002, "", "blank", 0), (2_003, " \n\t", "small", 0)]


def as_tuples(found):
    return sorted((r.doc_id, r.source, r["pass"], r.block, r.order_key, r.n_tokens, round(r.weight, 9)) for r in found)


def test_against_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(rows(), SCHEMA)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(OP3_SQL).df().to_dict("records")
    found = mix_sources(df).collect()
    assert as_tuples(found) == sorted((r["doc_id"], r["source"], r["pass"], r["block"], r["order_key"], r["n_tokens"], round(r["weight"], 9)) for r in want)
    assert max(r["pass"] for r in found) >= 1


def test_targets_budget_and_blocks(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    tokens = {"big": sum(1 + i % 7 for i in range(600)), "small": 100, "": 3}
    total = sum(tokens.values())
    base = df.selectExpr("coalesce(source, '') as source", "cast(size(array_remove(split(coalesce(text, ''), '[ \\t\\n]+'), '')) as long) as tokens")
    quotas, a, budget, _ = source_quotas(base, None, 0.8, None)
    w = {r.source: r.weight for r in quotas.collect()}
    assert budget == total and 0 < a < 1 and abs(sum(w.values()) - 1) < 1e-9
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.8 * math.log(3)) < 1e-6
    quotas, a, _, _ = source_quotas(base, None, None, 2.0)
    assert abs(max(r.weight * total / r.tokens for r in quotas.collect()) - 2.0) < 1e-6
    found = mix_sources(df, entropy=None, repetition=2.0, block_tokens=500).collect()
    assert sum(r.n_tokens for r in found) <= total
    blocks = max(1, -(-total // 500))
    for b in range(blocks):
        got = sum(r.n_tokens for r in found if r.source == "big" and r.block == b)
        want = w_big = next(r.quota for r in quotas.collect() if r.source == "big") / blocks
        assert abs(got - want) <= 8 + 0.02 * w_big
    for r in {(x.doc_id, x["pass"]) for x in found if x["pass"] > 0}:
        assert (r[0], r[1] - 1) in {(x.doc_id, x["pass"]) for x in found}


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_balanced_sources_keep_every_document(spark):
    data = [(i * 100 + k, "w " * (3 + (i * k) % 5), f"s{i}", 0) for i in range(23) for k in range(1 + i % 3 * 0 + 7)]
    size = {i: sum(3 + (i * k) % 5 for k in range(7)) for i in range(23)}
    data += [(i * 100 + 50, "w " * (60 - size[i]), f"s{i}", 0) for i in range(23)]
    found = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in data)


def test_null_ids_repeated_rows_and_many_passes(spark):
    data = [(None, "a b c", "x", 0), (None, "a b c", "x", 0), (5, "a b c", "x", 0), (5, "a b c", "x", 0), (6, "w " * 12, "y", 0)]
    found = mix_sources(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(found) == 5 and sum(r.n_tokens for r in found) == 24
    tiny = [(1, "one", "tiny", 0), (2, "w " * 45_000, "large", 0)]
    found = mix_sources(spark.createDataFrame(tiny, SCHEMA), entropy=1.0, repetition=None)
    n, last = found.where("source = 'tiny'").selectExpr("count(*)", "max(pass)").first()
    assert abs(n - 22_500) <= 1 and last == n - 1
