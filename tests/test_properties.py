"""Property tests: the custom distributed operators equal their plain definitions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from waypoint.operators.joins import lookup_join
from waypoint.operators.ordered import dense_ids, exclusive_running_totals

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.one_of(st.none(), st.integers(0, 6))


@SETTINGS
@given(fact=st.lists(st.tuples(keys, st.integers(0, 3)), max_size=60),
       dim=st.lists(keys, unique=True, max_size=8),
       hot=st.lists(keys, unique=True, max_size=3),
       how=st.sampled_from(["inner", "left", "left_semi", "left_anti"]),
       null_safe=st.booleans(), salts=st.integers(2, 5), spread=st.booleans())
def test_lookup_join_equals_plain(spark, fact, dim, hot, how, null_safe, salts, spread):
    f = spark.createDataFrame(fact, "k long, v long")
    d = spark.createDataFrame([(k, f"n{k}") for k in dim], "k long, name string")
    got = lookup_join(f, d, "k", how, hot=tuple(hot), null_safe=null_safe, salts=salts,
                      spread_copies=spread)
    want = lookup_join(f, d, "k", how, hot=(), null_safe=null_safe)
    norm = lambda x: sorted(tuple(map(str, r)) for r in x.select(*sorted(x.columns)).collect())
    assert norm(got) == norm(want)


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.text("abc", max_size=3)), max_size=40),
       parts=st.integers(1, 6))
def test_dense_ids_property(spark, vals, parts):
    df = spark.createDataFrame([(v,) for v in vals], "k string")
    got = {r.k: r.ccid for r in dense_ids(df, "k", num_partitions=parts).collect()}
    order = sorted(set(vals), key=lambda v: (v is not None, v or ""))
    assert got == {v: i + 1 for i, v in enumerate(order)}


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 9)),
                     unique_by=lambda r: (r[0], r[1], r[2]), max_size=50),
       parts=st.integers(1, 7))
def test_running_totals_property(spark, rows, parts):
    data = [(k, d, c, float(c % 4 + 1)) for k, d, c in rows]
    df = spark.createDataFrame(data, "k long, d long, c long, v double")
    got = {(r.k, r.d, r.c): (r.before, r.n) for r in exclusive_running_totals(
        df, "k", ["d", "c"], {"before": "v"}, count_out="n", num_partitions=parts).collect()}
    want = {}
    for k in {r[0] for r in data}:
        acc, n = 0.0, 0
        for _, d, c, v in sorted(r for r in data if r[0] == k):
            want[(k, d, c)] = (acc, n)
            acc += v
            n += 1
    assert got == want


@SETTINGS
@given(values=st.lists(st.integers(0, 12), min_size=1, max_size=40), k=st.integers(1, 11))
def test_growth_multipliers_property(spark, values, k):
    import math

    from waypoint.operators.transitions import growth_multipliers
    from waypoint.params import ModelParams
    v = sorted(float(x) for x in values)
    n = len(v)
    groups = {}
    for i, x in enumerate(v, start=1):
        groups.setdefault(math.floor(((i - 1) / n) * k) / k, []).append(x)
    mean = sum(v) / n
    df = spark.createDataFrame([(x,) for x in v], "trip_elements_current_year double")
    got = {r.percentile_group: (r.group_mean_trip_elements, r.group_multiplier)
           for r in growth_multipliers(df, ModelParams(num_buckets=k)).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        gm = sum(xs) / len(xs)
        assert abs(got[g][0] - gm) <= 1e-9 * max(1.0, abs(gm))
        if mean:
            assert abs(got[g][1] - gm / mean) <= 1e-9 * max(1.0, abs(gm / mean))
        else:
            assert got[g][1] is None


@SETTINGS
@given(cells=st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=4), min_size=1, max_size=6),
       seed=st.integers(0, 99))
def test_segment_draw_property(spark, cells, seed):
    import hashlib

    from waypoint.operators.segments import draw_segments
    rows, want = [], {}
    for ccid, counts in enumerate(cells, start=1):
        names = [f"s{i}" for i in range(len(counts))]
        n_cell, cum = sum(counts), 0
        h = int(hashlib.md5(f"{seed}:{ccid}".encode()).hexdigest()[:13], 16)
        pick = None
        for name, n in zip(names, counts):
            cum += n
            rows.append((ccid, name, n, cum, n_cell))
            if pick is None and cum * 2 ** 52 > h * n_cell:
                pick = name
        want[ccid] = pick
    df = spark.createDataFrame(rows, "ccid long, segment_nm string, n long, cum_n long, n_cell long")
    got = {r.ccid: r.segment for r in draw_segments(df, seed).collect()}
    assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=30))
def test_unique_only_property(spark, rows):
    from collections import Counter

    from waypoint.operators.segments import unique_only
    counts = Counter(k for k, _ in rows)
    want = sorted((k, v) for k, v in rows if counts[k] == 1)
    df = spark.createDataFrame(rows, "k long, v long")
    assert sorted(tuple(r) for r in unique_only(df, "k").collect()) == want


@SETTINGS
@given(xs=st.lists(st.decimals(min_value=0, max_value=20000, places=2), min_size=1, max_size=20),
       step=st.integers(1, 5000), steps=st.integers(1, 6))
def test_spend_cut_property(spark, xs, step, steps):
    import math

    from pyspark.sql import functions as F

    from waypoint.functions.kernel import spend_cut
    cap = step * steps
    df = spark.createDataFrame([(x,) for x in xs], "x decimal(18,2)")
    got = [r.c for r in df.select(spend_cut(F.col("x"), step, cap).alias("c")).collect()]
    want = [float(cap) if float(x) > cap else float(math.floor(float(x) / step) * step) for x in xs]
    assert got == want


@SETTINGS
@given(custs=st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 4), st.integers(0, 4),
                                st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=5),
       bookings=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 3),
                                   st.integers(1, 5), st.integers(0, 900), st.booleans()),
                         min_size=1, max_size=25),
       frac=st.sampled_from([0.039679166667, 0.4, 1.0]))
def test_simulator_outputs_property(spark, custs, bookings, frac):
    from collections import defaultdict

    from waypoint.operators import outputs as O
    from waypoint.params import ModelParams
    rows = []
    for ci, te_start, bk_start, te, gbv, pkg in bookings:
        ci %= len(custs)
        seg, te_prev, te_cur, bk_prev, bk_cur = custs[ci]
        rows.append((ci, seg, 1.0, float(te), float(te_start), float(te_cur), float(te_prev),
                     float(bk_start), float(bk_cur), float(bk_prev), pkg, float(gbv)))
    schema = ("ccid long, segment string, bookings double, trip_elements double, "
              "trip_elements_start_of_booking double, trip_elements_current_year double, "
              "trip_elements_prev_year double, bookings_start_of_booking double, "
              "bookings_current_year double, bookings_prev_year double, is_package boolean, "
              "gbvlc double")
    bu = spark.createDataFrame(rows, schema)
    p = ModelParams(extract_fraction=frac, brand="X")
    views = {"trip_elements": (6, 5, 4), "bookings": (9, 8, 7)}  # prev, current, start
    want_b = defaultdict(float)
    for r in rows:
        for t, (ip, ic, is_) in views.items():
            want_b[(r[1], r[ip], r[ic], r[is_], t)] += r[2]
    want_b = sorted((k[0], float(round(k[1])), float(round(k[2])), float(round(k[3])), k[4],
                     float(round(v / frac))) for k, v in want_b.items())
    got_b = sorted(tuple(r) for r in O.bookings_for_simulator(O.unit_views(bu), p).collect())
    assert got_b == want_b
    members = defaultdict(lambda: [set(), 0.0, 0.0, 0.0, 0])
    for r in rows:
        for t, (ip, ic, _) in views.items():
            m = members[(r[1], r[ip], r[ic], t)]
            m[0].add(r[0]); m[1] += r[11]; m[2] += r[2]; m[3] += r[3]; m[4] += int(r[10])
    want_m = sorted((k[0], float(round(k[1])), float(round(k[2])), k[3], float(round(len(m[0]) / frac)),
                     float(round(m[1] / frac)), float(round(m[2] / frac)),
                     float(round(m[3] / frac)), float(round(m[4] / frac)))
                    for k, m in members.items())
    got_m = sorted(tuple(r) for r in O.members_for_simulator(bu, p).collect())
    assert got_m == want_m


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.sampled_from(["air", "car"])),
                               st.one_of(st.none(), st.integers(1, 4)),
                               st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=25))
def test_lob_metrics_and_flag_sums_property(spark, rows):
    from collections import defaultdict

    from waypoint.operators.respondents import flag_sums, lob_metrics_wide, respondent_rollup
    df = spark.createDataFrame(
        [(c, lob, code, None if v is None else float(v), None if v is None else float(v),
          0.0, 0.0, None if v is None else float(v)) for c, lob, code, v in rows],
        "ccid long, lob string, booking_code long, unit_count double, gbv double, "
        "loyalty_amount_net_burned_usd double, loyalty_amount_net_earned_usd double, f double")
    levels = ["air", "car", None]
    got = {r.ccid: r for r in lob_metrics_wide(respondent_rollup(df, ("f",)), levels).collect()}
    cells = defaultdict(list)
    for c, lob, code, v in rows:
        cells[(c, lob)].append((code, v))
    for c in {r[0] for r in rows}:
        for lv in levels:
            name = "NA" if lv is None else lv
            xs = cells.get((c, lv), [])
            assert got[c][f"num_bookings_lob_{name}"] == len({code for code, _ in xs})
            want = 0 if not xs else (None if any(v is None for _, v in xs) else sum(v for _, v in xs))
            assert got[c][f"unit_count_lob_{name}"] == want
    sums = {r.ccid: r.f for r in flag_sums(respondent_rollup(df, ("f",)), ("f",)).collect()}
    for c in {r[0] for r in rows}:
        vs = [v for cc, _, _, v in rows if cc == c]
        assert sums[c] == (None if any(v is None for v in vs) else float(sum(vs)))


@SETTINGS
@given(lines=st.lists(st.tuples(st.integers(1, 4), st.integers(0, 5), st.integers(2021, 2025),
                                st.sampled_from(["air", "car", "bus"]), st.integers(0, 3)),
                      min_size=1, max_size=30),
       members=st.sets(st.integers(1, 4), min_size=1))
def test_customer_units_property(spark, lines, members):
    import datetime as dt

    from waypoint.operators.units import booking_years, customer_booking_lobs, customer_units
    from waypoint.params import ModelParams
    p = ModelParams(analysis_year=2024, brand="B", lobs=("air", "car"))
    tx = spark.createDataFrame(
        [(c, code, dt.date(y, 3, 1 + code), lob, float(u), "B", 10.0)
         for c, code, y, lob, u in lines],
        "ccid long, booking_code long, begin_use_date date, lob string, unit_count double, "
        "eg_brand_code string, gbv double")
    dim = spark.createDataFrame([(m, "S") for m in members], "ccid long, segment string")
    by_lob = customer_booking_lobs(tx, dim, p)
    got = {r.ccid: r for r in customer_units(booking_years(None, p, by_lob=by_lob), p).collect()}
    q = [(c, code, y, u) for c, code, y, lob, u in lines
         if c in members and lob in ("air", "car") and u > 0]
    want = {}
    for c in {r[0] for r in q if r[2] == 2024}:
        cur = [r for r in q if r[0] == c and r[2] == 2024]
        prev = [r for r in q if r[0] == c and r[2] == 2023]
        want[c] = (float(sum(r[3] for r in cur)), len({r[1] for r in cur}),
                   float(sum(r[3] for r in prev)) if prev else None,
                   len({r[1] for r in prev}) if prev else None)
    assert {c: (r.trip_elements_current_year, r.bookings_current_year,
                r.trip_elements_prev_year, r.bookings_prev_year) for c, r in got.items()} == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(1, 3), st.integers(0, 4), st.sampled_from(["air", "lodging", "car"]),
                               st.integers(1, 5), st.integers(0, 50)), min_size=1, max_size=25,
                     unique_by=lambda r: (r[0], r[1], r[2])),
       active=st.sets(st.integers(1, 3), min_size=1), pkg=st.sets(st.integers(0, 4)))
def test_booking_lob_wide_property(spark, rows, active, pkg):
    from waypoint.operators.units import booking_lob_wide, wide_columns
    from waypoint.params import ModelParams
    p = ModelParams(brand="B")
    by_lob = spark.createDataFrame([(c, b, l, float(t), float(g)) for c, b, l, t, g in rows],
                                   "ccid long, booking_code long, lob string, trip_elements double, "
                                   "gbvlc double")
    act = spark.createDataFrame([(a,) for a in active], "ccid long")
    packages = spark.createDataFrame([(b, b in pkg) for b in range(5)],
                                     "booking_code long, is_package boolean")
    got = {r.booking_code: r for r in booking_lob_wide(by_lob, act, packages, p).collect()}
    codes = {b for c, b, _, _, _ in rows if c in active}
    assert set(got) == codes
    for b in codes:
        mine = [r for r in rows if r[1] == b and r[0] in active]
        for lob in p.lobs:
            xs = [r for r in mine if r[2] == lob]
            vals = {"gbvlc": float(sum(r[4] for r in xs)), "bookings": 1.0 if xs else 0.0,
                    "trip_elements": float(sum(r[3] for r in xs))}
            for m, v in vals.items():
                on, off = (f"lob_{m}_{lob}_package", f"lob_{m}_{lob}") if b in pkg else \
                          (f"lob_{m}_{lob}", f"lob_{m}_{lob}_package")
                assert got[b][on] == v and got[b][off] == 0
        assert sorted(got[b].asDict()) == sorted(["booking_code"] + wide_columns(p))
