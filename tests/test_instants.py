import time
from datetime import datetime, timezone

import pytest

from canteria.functions.instants import to_utc_us
from canteria.operators import instants, skew
from canteria.session import new_path

MADRID, NEW_YORK = "Europe/Madrid", "America/New_York"


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 10**6 + micro


@pytest.mark.parametrize(
    ("raw", "zona", "orden", "want"),
    [
        ("2023-01-03T06:30:46Z", None, None, us(2023, 1, 3, 6, 30, 46)),
        ("2023-01-03t06:30:46z", None, None, us(2023, 1, 3, 6, 30, 46)),
        ("2023-01-03T18:41:57-06:00", MADRID, "dmy", us(2023, 1, 4, 0, 41, 57)),
        ("2023-01-08T15:05:20.514+0000", None, None, us(2023, 1, 8, 15, 5, 20, micro=514000)),
        ("2023-01-08T18:54:39.528000710Z", None, None, us(2023, 1, 8, 18, 54, 39, micro=528000)),
        ("2023-01-11T14:15:23,000−03:00", None, None, us(2023, 1, 11, 17, 15, 23)),
        ("２０２３-０１-０２T０３:５３:２０-０６:００", None, None, us(2023, 1, 2, 9, 53, 20)),
        ("2023-01-09T01:41:14-06:00[America/Mexico_City]", None, None, us(2023, 1, 9, 7, 41, 14)),
        ("1672867312", None, None, 1672867312 * 10**6),
        ("1673126368000", None, None, 1673126368 * 10**6),
        ("1673610764559986", None, None, 1673610764559986),
        ("1675492741.09", None, None, 1675492741090000),
        ("2023-07-02T12:00:00", MADRID, "dmy", us(2023, 7, 2, 10)),
        ("2023-07-02", MADRID, "dmy", us(2023, 7, 1, 22)),
        ("2023-01-10T17:05", MADRID, "dmy", us(2023, 1, 10, 16, 5)),
        ("02/03/2023 19:00:53", MADRID, "dmy", us(2023, 3, 2, 18, 0, 53)),
        ("02/03/2023 07:00:53 PM", NEW_YORK, "mdy", us(2023, 2, 4, 0, 0, 53)),
        ("12/01/2023 12:00:00 AM", NEW_YORK, "mdy", us(2023, 12, 1, 5)),
        ("2023/01/03 10:29:25", "UTC", "ymd", us(2023, 1, 3, 10, 29, 25)),
        ("31/31/2024 09:00:00", "UTC", "ymd", None),
        ("20230102T221435Z", None, None, us(2023, 1, 2, 22, 14, 35)),
        ("2023-002T05:33:19", "UTC", "ymd", us(2023, 1, 2, 5, 33, 19)),
        ("2023-366T05:33:19", "UTC", "ymd", None),
        ("2023-W03-5T12:47:03-06:00", None, None, us(2023, 1, 20, 18, 47, 3)),
        ("2023-01-17 17:49:39 GMT-06:00", None, None, us(2023, 1, 17, 23, 49, 39)),
        ("2023-02-22 12:07:52 UTC-6", None, None, us(2023, 2, 22, 18, 7, 52)),
        ("2023-01-10 08:59:22 UTC", None, None, us(2023, 1, 10, 8, 59, 22)),
        ("2023-01-02 01:15:07 America/Santiago", None, None, us(2023, 1, 2, 4, 15, 7)),
        ("2023-04-07 11:45:47 CEST", MADRID, "dmy", us(2023, 4, 7, 9, 45, 47)),
        ("2023-01-15 09:32:33 CST", "America/Chicago", "mdy", us(2023, 1, 15, 15, 32, 33)),
        ("2023-01-15 09:32:33 CST", "Asia/Shanghai", "ymd", us(2023, 1, 15, 1, 32, 33)),
        ("2023-01-15 09:32:33 CST", None, None, None),
        ("01-abr-2023 22:55:51", "UTC", "dmy", us(2023, 4, 1, 22, 55, 51)),
        ("11 de junio de 2023, 06:11:21", "UTC", "dmy", us(2023, 6, 11, 6, 11, 21)),
        ("Dec 14, 2023 5:45:56 PM", "UTC", "ymd", us(2023, 12, 14, 17, 45, 56)),
        ("Mar 22, 2023 2:10:24 AM", "UTC", "ymd", us(2023, 3, 22, 2, 10, 24)),
        ("May 5, 2023 3:03:12 PM", "UTC", "ymd", us(2023, 5, 5, 15, 3, 12)),
        ("Mar, 14 Mar 2023 10:00:00 +0000", None, None, us(2023, 3, 14, 10)),
        ("martes 14 de marzo de 2023, 10:00:00", "UTC", "dmy", us(2023, 3, 14, 10)),
        ("Sun, 07 May 2023 10:50:48 -0500", None, None, us(2023, 5, 7, 15, 50, 48)),
        ("Mon, 09 Jan 2023 23:02:01 GMT", None, None, us(2023, 1, 9, 23, 2, 1)),
        (" 2023-01-18T06:23:58\xa0", "UTC", "ymd", us(2023, 1, 18, 6, 23, 58)),
        ("2023-10-29T02:30:00", MADRID, "dmy", us(2023, 10, 29, 0, 30)),  # occurs twice: the earlier
        ("2023-10-29 02:30:00 CET", MADRID, "dmy", us(2023, 10, 29, 1, 30)),
        ("2023-03-26T02:30:00", MADRID, "dmy", us(2023, 3, 26, 1, 30)),  # skipped: the offset before
        ("2024-03-05 10:00Z (UTC)", MADRID, "dmy", us(2024, 3, 5, 10)),
        ("2024-03-05 10:00 UTC (hora de la máquina que escribió este registro, como consta en el acta de la sesión anterior)", MADRID, "dmy", us(2024, 3, 5, 10)),
        ("2024-03-05 10:00 (UTC)", MADRID, "dmy", us(2024, 3, 5, 10)),
        ("2024-03-05 10:00 (America/New_York)", MADRID, "dmy", us(2024, 3, 5, 15)),
        ("2024-03-05 10:00 (hora local)", MADRID, "dmy", us(2024, 3, 5, 9)),
        ("Tue 5 Mar 2024 10:00 UTC", None, None, us(2024, 3, 5, 10)),
        ("mar 5 mar 2024 10:00 UTC", None, None, us(2024, 3, 5, 10)),
        ("mar. 5 de marzo de 2024 10:00 UTC", None, None, us(2024, 3, 5, 10)),
        ("Mar 5 2024 10:00 UTC", None, None, us(2024, 3, 5, 10)),
        ("Tue Mar 05 2024 10:00:00 GMT+0100 (Central European Standard Time)", None, None, us(2024, 3, 5, 9)),
        ("Tue Mar  5 10:00:00 2024", MADRID, "dmy", us(2024, 3, 5, 9)),
        ("Tue Mar  5 10:00:00 UTC 2024", None, None, us(2024, 3, 5, 10)),
        *[(f"2024-03-05 10:00{x}", MADRID, "dmy", None) for x in ("+01:00]", "+01:00[]", "+01:00 [a] [b]", "+01:00 (a) b", "[UTC", "(", ")", "+19:00", "+01:60")],
        ("2024-03-05 10:00[UTC] (nota)", MADRID, "dmy", us(2024, 3, 5, 10)),
        *[(x, MADRID, "dmy", None) for x in (None, "", "  ", "n/d", "pendiente", "ayer 14:03", "14:03:11", "0000-00-00 00:00:00", "2025-02-30T10:00:00", "2024-13-01T08:15:00", "2025-06-03T25:61:00", "MATERIALIZAR", "x" * 100_000)],
        ("2023-01-31T15:42:55", None, None, None),
    ],
)
def test_notations(raw, zona, orden, want):
    assert to_utc_us(raw, zona, orden) == want


@pytest.mark.parametrize("tail", ["(" * 200_000, "(" * 100_000 + ")" * 100_000, " " * 200_000 + "x", "[" * 200_000, " " * 200_000 + "]", "de " * 100_000, "9" * 200_000, "." * 200_000])
def test_long_junk_is_read_in_no_time(tail):
    begun = time.perf_counter()
    assert to_utc_us(f"2024-03-05 10:00{tail}", MADRID, "dmy") is None
    to_utc_us(f"5 {tail} de marzo de 2024", MADRID, "dmy")
    to_utc_us(tail, MADRID, "dmy")
    assert time.perf_counter() - begun < 5


def _tables(spark, rows):
    version = spark.createDataFrame(rows, "seq long, capture_ts string, equipo string, raw string, n int")
    equipo = spark.createDataFrame([("m", MADRID, "dmy"), ("m", MADRID, "dmy"), (None, "UTC", "ymd")], "equipo string, zona string, orden_fecha string")
    return instants.written_values(version, "version", ["capture_ts"], equipo)


def test_dictionary_is_extended_not_reparsed(spark):
    first = _tables(spark, [(1, "2023-07-02T12:00:00", "m", "x", 1), (2, "2023-07-02T12:00:00", "m", "x", 1), (3, "2023-07-02T12:00:00", None, "x", 1), (4, None, "m", "x", 1)])
    kept = instants.InstantDictionary(spark, new_path(spark, "dictionary"))
    got = {(r.seq, r.utc_us) for r in instants.normalise_instants(first, kept).collect()}
    assert got == {(1, us(2023, 7, 2, 10)), (2, us(2023, 7, 2, 10))}
    size = kept.read().count()
    second = _tables(spark, [(5, "2023-07-02T12:00:00", "m", "x", 1), (6, "2023-07-02T12:00:00Z", "zz", "x", 1)])
    got = {(r.seq, r.utc_us) for r in instants.normalise_instants(second, kept).collect()}
    assert got == {(5, us(2023, 7, 2, 10)), (6, us(2023, 7, 2, 12))}
    assert kept.read().count() == size + 1


def test_second_run_parses_nothing(spark, tmp_path):
    rows = _tables(spark, [(1, "2023-07-02T12:00:00", "m", "x", 1), (2, "n/d", "m", "x", 1)])
    kept = instants.InstantDictionary(spark, str(tmp_path / "kept"))
    first = [tuple(r) for r in instants.normalise_instants(rows, kept).collect()]
    batches = sorted(p.name for p in (tmp_path / "kept").iterdir())
    assert [tuple(r) for r in instants.normalise_instants(rows, instants.InstantDictionary(spark, kept.path)).collect()] == first
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == batches


def test_value_added_by_two_writers_counts_once(spark):
    rows = _tables(spark, [(1, "2023-07-02T12:00:00", "m", "x", 1)])
    kept = instants.InstantDictionary(spark, new_path(spark, "dictionary"))
    counts, total = kept.extend(rows)
    batch = spark.read.parquet(kept.path).select(*instants.KEYS, "utc_us")
    batch.write.parquet(f"{kept.path}/lote=other")
    assert kept.read().count() == batch.distinct().count() and kept.attach(rows, counts, total).count() == 1
    before = sorted(map(tuple, kept.read().collect()))
    kept.compact()
    assert sorted(map(tuple, kept.read().collect())) == before == sorted(map(tuple, spark.read.parquet(kept.path).select(*instants.KEYS, "utc_us").collect()))


@pytest.mark.parametrize("least", [10, 50_000])
def test_hot_value_keeps_all_rows(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "HOT_ROWS", least)
    rows = _tables(spark, [(i, "2023-07-02" if i % 3 else "n/d", "m", "x", 1) for i in range(6000)])
    assert instants.normalise_instants(rows, instants.InstantDictionary(spark, None)).count() == 4000


def test_empty_table(spark):
    assert instants.normalise_instants(_tables(spark, [])).count() == 0


@pytest.mark.parametrize("raw", ["Tue,{}3 Jan 2023 06:30:46 GMT", "2023-01-03 06:30:46{}Z"])
@pytest.mark.parametrize("space", [" ", "\u2028", "\u1680"])
def test_length_does_not_decide(raw, space):
    assert to_utc_us(raw.format(space * 90)) == us(2023, 1, 3, 6, 30, 46)
