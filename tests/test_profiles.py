"""Summaries of records whose lists are null, empty, or hold nulls."""

from pyspark.sql import functions as F

from tallyweave.functions import profiles as pf
from tallyweave.schema import SAMPLE, TANK


def unknown(kind):
    return F.lit(None).cast(f"array<{kind}>")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_nothing_known(spark):
    for samples in (unknown(SAMPLE), F.array().cast(f"array<{SAMPLE}>"), F.array(F.lit(None).cast(SAMPLE))):
        r = one(spark, e=pf.extremes(samples), r=pf.tank_readings(samples), t=pf.primary_transmitter(samples), n=pf.channel_names(samples), c=pf.on_loop(F.lit(None).cast("string"), unknown(TANK), samples))
        assert tuple(r["e"]) == (0.0, None, None, 0)
        assert (r["r"], r["t"], r["n"], r["c"]) == ({}, None, [], False)
    assert one(spark, p=pf.header_problem(unknown(SAMPLE), F.lit(1.0), F.lit(1), F.lit(1)))["p"] == "none"


def test_mixes_keep_their_order(spark):
    gas = lambda o, h: F.struct(F.lit(o).cast("double").alias("oxygen"), F.lit(h).cast("double").alias("helium"))
    got = one(spark, m=pf.mixes(F.array(gas(32, 0), gas(0, None), gas(21, 35), gas(32, None), gas(None, 10))))["m"]
    assert [tuple(x) for x in got] == [(32, 0), (21, 35), (0, 10)]


def test_diluents_without_a_known_mix_keep_theirs(spark):
    tank = F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in (("oxygen", "double", 21), ("helium", "double", 0), ("start", "double", None), ("end", "double", None), ("volume", "double", None), ("name", "string", "D1"), ("role", "string", None))])
    none = F.array().cast("array<struct<oxygen:double,helium:double>>")
    got = one(spark, t=pf.loop_tanks(F.lit("ccr"), F.array(tank), none, none), u=pf.loop_tanks(F.lit("ccr"), unknown(TANK), none, none))
    assert (got["t"][0]["role"], got["t"][0]["oxygen"], got["u"]) == ("diluent", 21.0, None)


def test_cells_with_one_own_word_all_count(spark):
    words = lambda *w: [F.lit(x) for x in w]
    got = one(spark, new=pf.cell_factors(F.lit(7), *words(2100, 2100, 2100)), own=pf.cell_factors(F.lit(5), *words(2100, 9, 2000)), off=pf.cell_factors(F.lit(0), *words(1, 2, 3)), null=pf.cell_factors(F.lit(None).cast("int"), *words(1, 2, 3)))
    assert (got["new"], got["own"], got["off"], got["null"]) == ({}, {0: 0.021, 2: 0.02}, {}, {})


def test_two_transmitters_of_one_tank(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    call = lambda pressures, tank_of: pf.logged_channels(F.lit(None).cast("double"), F.lit(2), F.lit(False), F.lit(1), F.lit(1.0), F.lit(0.1), pressures, tank_of)["pressures"]
    got = one(spark, a=call(m(0, 10.0, 1, 20.0, 2, 30.0), m(0, 4, 1, 4)), b=call(m(1, 20.0, 0, 10.0), m(1, 0)))
    assert got["a"] == {4: 20.0, 2: 30.0}
    assert got["b"] == {0: 20.0}


def test_odd_samples_on_a_grid(spark):
    """Equal times, samples off the grid, wide gaps, unknown depths and temperatures."""
    from tallyweave.functions.compare import resampled

    def grid(given):
        timed = sorted((s for s in given if s[0] is not None), key=lambda s: s[0])
        gaps = [b[0] - a[0] for a, b in zip(timed, timed[1:]) if b[0] > a[0]]
        if len(set(gaps)) <= 1:
            return [tuple(s) for s in timed]
        rate, out = max(gaps, key=lambda g: (gaps.count(g), -gaps.index(g))), []
        for g in range(timed[0][0], timed[-1][0] + 1, rate):
            a = next(s for s in reversed(timed) if s[0] <= g)
            b = next((s for s in timed if s[0] > g), None)
            lerp = lambda i: a[i] if g == a[0] or a[i] is None or b[i] is None else a[i] + (b[i] - a[i]) * ((g - a[0]) / (b[0] - a[0]))  # noqa: B023, E731
            out.append((g, round(lerp(1), 3), None if lerp(2) is None else round(lerp(2), 2)))
        return out

    cases = [
        [(0, 1.0, 20.0), (10, 2.0, None), (13, 2.5, 19.0), (20, 3.0, 18.0), (30, 4.0, None)],
        [(5, 1.0, 20.0), (15, 2.0, 19.0), (15, 2.5, 18.5), (25, 3.0, 18.0), (60, 4.0, 11.0)],
        [(0, 1.0, None), (4, 2.0, 9.0), (8, 3.0, 8.0), (9, 4.0, 7.0), (22, 9.0, 1.0), (None, 7.0, 1.0)],
        [(30, 1.0, 1.0), (0, 2.0, 2.0), (10, 3.0, 3.0), (20, 4.0, 4.0), (37, 5.0, 5.0)],
        [(0, 1.0, 1.0)], [(3, 1.0, 1.0), (3, 2.0, 2.0), (9, 3.0, 3.0)],
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, s array<struct<t:int,depth:double,temp:double>>")
    got = {r[0]: [tuple(x) for x in r[1]] for r in rows.select("k", resampled(F.col("s"))).collect()}
    assert got == {k: grid(c) for k, c in enumerate(cases)}


def test_profiles_off_grid_need_no_lists_of_lines(spark):
    from comparing import DATA

    from tallyweave.catalogue import QUERIES, load

    load()
    plan = QUERIES["pred_same_profile_off_grid"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
