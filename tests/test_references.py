import shutil

from pyspark.sql import functions as F

from canteria.functions.text import key_bytes, key_text
from canteria.operators import references as R
from canteria.operators import skew
from canteria.session import list_files, materialize, read_text, write_text

HEX = "ab" * 32


def test_classes(spark):
    refs = spark.createDataFrame(
        [(10, HEX, "2024-05-01T00:00:00"), (11, "gone", "2024-05"), (12, "late", None), (30, "late", ""), (13, "drawn", "x"), (14, "", "x"), (15, None, "x"), (16, " ", "x"), (17, HEX.upper(), "x"), (18, "both", "x"), (18, "both", "x")],
        "seq long, ref_id string, ts string",
    )
    target = spark.createDataFrame([(1, HEX), (20, "late"), (25, "late"), (2, "drawn"), (3, None), (50, HEX)], "seq long, id string")
    baja = spark.createDataFrame([("t", "drawn"), ("t", "drawn"), ("other", HEX), (None, HEX), ("t", None), ("t", "both")], "tabla string, id string")
    rows = R.reference_rows(refs, "a", "ref_id", "t")
    state = R.merge_state(R.reference_deltas(rows), R.existence_deltas(target, "t"), R.withdrawal_deltas(baja, ["t"]))
    got = sorted((r.seq, r.periodo, r.clase, r.id) for r in R.classify_references(rows, state).collect())
    assert got == [(11, "2024-05", "ausente", "gone"), (12, "", "tardia", "late"), (13, "x", "baja", "drawn"), (16, "x", "ausente", " "), (17, "x", "ausente", HEX.upper()), (18, "x", "baja", "both"), (18, "x", "baja", "both")]


def test_state_is_kept_up_by_merging(spark):
    day1 = R.reference_rows(spark.createDataFrame([(1, "k", "x")], "seq long, ref_id string, ts string"), "a", "ref_id", "t")
    state = R.merge_state(R.reference_deltas(day1))
    assert [r.clase for r in R.orphan_keys(state).collect()] == ["ausente"]
    state = R.merge_state(state, R.existence_deltas(spark.createDataFrame([(5, "k")], "seq long, id string"), "t"))
    assert [r.clase for r in R.orphan_keys(state).collect()] == ["tardia"]
    state = R.merge_state(state, R.withdrawal_deltas(spark.createDataFrame([("t", "k")], "tabla string, id string"), ["t"]))
    assert [r.clase for r in R.orphan_keys(state).collect()] == ["baja"]


def test_keys_come_back(spark):
    texts = [HEX, "", " ", "é", HEX.upper(), HEX + "0", "\x01" + HEX, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", key_bytes(F.col("t")).alias("k"))
    assert df.select("k").distinct().count() == len(texts)
    assert all(r.t == r.b for r in df.select("t", key_text(F.col("k")).alias("b")).collect())


def test_hot_missing_key_keeps_all_rows(spark):
    refs = spark.range(90_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ref_id"), F.lit("2024").alias("ts"))
    rows = R.reference_rows(refs, "a", "ref_id", "t")
    assert R.classify_references(rows, R.merge_state(R.reference_deltas(rows))).count() == 90_000


def test_few_orphans_among_many_references_broadcast_few_keys(spark, monkeypatch):
    """The list of hot keys is measured against all references, not only those to orphans."""
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 1000)
    refs = spark.range(60_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("ref_id"), F.lit("2024").alias("ts"))
    gone = spark.range(20).select((F.col("id") + 60_000).alias("seq"), F.lit("gone").alias("ref_id"), F.lit("2024").alias("ts"))
    rows = R.reference_rows(refs.unionByName(gone), "a", "ref_id", "t")
    stored = refs.select(F.lit(-1).cast("long").alias("seq"), F.col("ref_id").alias("id")).distinct()
    state, _ = materialize(R.merge_state(R.reference_deltas(rows), R.existence_deltas(stored, "t")), "state")
    counts = state.where("referencias > 0").select(*R.STATE, F.col("referencias").alias("_n"))
    hot = skew.hot_keys(counts, R.STATE, 60_020)
    assert [(r.clave, r["_k"]) for r in hot.collect()] == [(b"\x00hot", -(-20_000 // 60))]
    assert R.classify_references(rows, state).count() == 20


def _folder(spark, at, tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/{name}.parquet")


def _update(spark, at, kept):
    refs = R.reference_rows(spark.read.parquet(f"{at}/a.parquet"), "a", "ref_id", "t")

    def deltas(added):
        a, t, b = added("a"), added("t"), added("baja")
        return [
            *([R.reference_deltas(R.reference_rows(a, "a", "ref_id", "t"))] if a is not None else []), *([R.existence_deltas(t, "t")] if t is not None else []),
            *([R.withdrawal_deltas(b, ["t"])] if b is not None else []),
        ]

    state = kept.update({n: f"{at}/{n}.parquet" for n in ("a", "t", "baja")}, deltas)
    return {(r.seq, r.clase) for r in R.classify_references(refs, state).collect()}


def test_kept_state_reads_only_new_files(spark, tmp_path):
    at, kept = str(tmp_path / "tables"), str(tmp_path / "kept")
    a, t, b = "seq long, ref_id string, ts string", "seq long, id string", "tabla string, id string"
    _folder(spark, at, {"a": (a, [(1, "k", "x"), (2, "m", "x"), (3, "n", "x")]), "t": (t, [(0, "n")]), "baja": (b, [("t", "zz")])})
    state = R.KeptState(spark, kept)
    assert _update(spark, at, state) == {(1, "ausente"), (2, "ausente")} and state.read_files == 3
    assert _update(spark, at, state) == {(1, "ausente"), (2, "ausente")} and state.read_files == 0
    _folder(spark, at, {"a": (a, [(5, "k", "y")]), "t": (t, [(4, "k")])})
    assert _update(spark, at, R.KeptState(spark, kept)) == {(1, "tardia"), (2, "ausente")}
    _folder(spark, at, {"baja": (b, [("t", "n")])})
    state = R.KeptState(spark, kept)
    assert _update(spark, at, state) == {(1, "tardia"), (2, "ausente"), (3, "baja")} and state.read_files == 1
    # A file of the state that changes makes it be built anew.
    shutil.rmtree(f"{at}/t.parquet")
    _folder(spark, at, {"t": (t, [(0, "m"), (0, "k")])})
    state = R.KeptState(spark, kept)
    assert _update(spark, at, state) == {(3, "baja")} and state.read_files == 5
    assert len(list((tmp_path / "kept" / "state").iterdir())) == len(list_files(spark, f"{kept}/manifest")) == 2


def test_a_manifest_is_never_overwritten(spark, tmp_path):
    assert write_text(spark, f"{tmp_path}/m/1", "a") and not write_text(spark, f"{tmp_path}/m/1", "b") and read_text(spark, f"{tmp_path}/m/1") == "a"
    assert list(list_files(spark, f"{tmp_path}/m")) == [f"file:{tmp_path}/m/1"] and list_files(spark, f"{tmp_path}/none") == {}


def test_empty(spark):
    rows = R.reference_rows(spark.createDataFrame([], "seq long, ref_id string, ts string"), "a", "ref_id", "t")
    assert R.classify_references(rows, R.merge_state(R.reference_deltas(rows))).count() == 0


def test_hex_id_with_a_line_break_is_another_id(spark):
    values = [HEX, HEX + "\n", HEX + "\r\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.o for r in df.select(key_text(key_bytes(F.col("v"))).alias("o")).collect()] == values
    refs = R.reference_rows(spark.createDataFrame([(10, HEX + "\n", "2024-05")], "seq long, ref_id string, ts string"), "a", "ref_id", "t")
    state = R.merge_state(R.reference_deltas(refs), R.existence_deltas(spark.createDataFrame([(1, HEX)], "seq long, id string"), "t"))
    assert [(r.seq, r.clase, r.id) for r in R.classify_references(refs, state).collect()] == [(10, "ausente", HEX + "\n")]
