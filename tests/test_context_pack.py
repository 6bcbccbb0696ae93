import datetime as dt
import zlib

from pitlake.plans.texts import context_pack


def test_context_pack_has_one_budget_a_ticker(spark, tmp_path):
    rows = [(f"e{n}", t, dt.datetime(2010 + n % 14, 1 + n % 12, 1), (n * 7 % 10) / 10) for n in range(60) for t in ("A", "B")]
    rows = [(f"{t}{e}", t, at, q) for e, t, at, q in rows]
    spark.createDataFrame(rows + rows[:9], "evidence_id string, ticker string, retrieved_at timestamp, data_quality_score double").write.parquet(f"{tmp_path}/evidence_refs.parquet")
    got = {x.evidence_id: (x.key, x.taken, x.used) for x in context_pack(spark, str(tmp_path)).collect()}
    want = {}
    for ticker in ("A", "B"):
        used = 0
        for e, t, _, _ in sorted((x for x in rows if x[1] == ticker), key=lambda x: (-x[3], -x[2].timestamp(), x[0])):
            size = zlib.crc32(e.encode()) % 400 + 20
            taken = used + size <= 1000
            used += size * taken
            want[e] = (t, taken, used)
    assert got == want
