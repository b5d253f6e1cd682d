import random
from datetime import date, datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import collect, config, delivery, gate, health, message, select, store
from tidemark.streaming.health import step


def test_new_and_capped(spark):
    c = spark.createDataFrame([(f"i{k}", f"s{k % 2}", k) for k in range(9)], "id string, source_id string, ord int")
    items = spark.createDataFrame([("i0",), ("i3",)], "id string")
    got = collect.capped_new(collect.new_candidates(c, items), 2).orderBy("ord").collect()
    assert [(r.id, r.rank, r.overflow) for r in got] == [("i1", 1, 1), ("i2", 1, 2), ("i4", 2, 2), ("i5", 2, 1)]


def test_rechecks_use_up_places(spark):
    known = spark.createDataFrame([("a", "s", 1, 1), ("b", "s", 2, 2), ("c", "s", 3, 3)], "id string, source_id string, updated_at int, ord int")
    assert [r.id for r in collect.rechecks(known, known.where("id = 'a'"), 2).collect()] == ["b"]


def test_update_quota_defers_later_rows(spark):
    known = spark.createDataFrame([("s", k) for k in range(6)], "source_id string, ord int")
    assert sorted(r.ord for r in collect.update_quota(known, F.col("ord") % 2 == 0, 2).collect()) == [0, 1, 2]


def test_last_digested_is_prefix_safe(spark):
    marks = F.array(*map(F.lit, ("welfare_2026-09-01", "welfare_child_2026-09-09", "welfare_2026-02-30")))
    assert spark.range(1).select(select.last_digested(marks, "welfare")).first()[0] == date(2026, 9, 1)


def test_modes():
    c = select.Channel("c", weekly_on=1)
    assert select.mode_of(c, date(2026, 9, 14)) == "weekly" and select.mode_of(c, date(2026, 9, 15)) == "urgent"
    assert select.mode_of(select.Channel("c"), date(2026, 9, 15)) == "daily"


def _item(id, detected, region=None, marks=(), rel=0.9, imp=2, dup=False, updated=None, classified=True):
    t = datetime.fromisoformat(detected)
    u = datetime.fromisoformat(updated) if updated else t
    return (id, t, u, u if classified else None, ["m"], rel, imp, dup, region, list(marks), date(2026, 9, 14))


_ITEM = "id string, detected_at timestamp_ntz, updated_at timestamp_ntz, classified_at timestamp_ntz, channels array<string>, relevance double, importance_rank int, is_duplicate_of_national boolean, region string, digested_in array<string>, deadline date"


def test_pool_edges_and_redelivery(spark):
    rows = [
        _item("a", "2026-09-11 22:00:00"), _item("b", "2026-09-12 21:59:59.999"), _item("c", "2026-09-12 22:00:00"), _item("d", "2026-09-11 21:59:59.999"),
        _item("e", "2026-09-08 21:59:59"), _item("f", "2026-09-01 00:00:00", marks=["m_2026-09-02"], updated="2026-09-10 00:00:00"),
        _item("g", "2026-09-01 00:00:00", marks=["m_2026-09-07"], updated="2026-09-10 00:00:00"),
    ]
    got = {r.id: r.reason for r in select.pool(spark.createDataFrame(rows, _ITEM), "m", date(2026, 9, 13)).collect()}
    assert got == {"a": "fresh", "b": "fresh", "d": "carried", "f": "updated"}


def test_national_suppression_needs_a_national_item(spark):
    c = select.Channel("m")
    rows = [_item("a", "2026-09-12 00:00:00", region="x", dup=True), _item("b", "2026-09-12 00:00:00", rel=0.1, classified=False)]
    assert [r.id for r in select.candidates(spark.createDataFrame(rows, _ITEM), c, "d").collect()] == []  # b is national, though not a candidate
    assert [r.id for r in select.candidates(spark.createDataFrame(rows[:1], _ITEM), c, "d").collect()] == ["a"]


def test_rank_ties(spark):
    rows = [_item(i, "2026-09-12 00:00:00", imp=m) for i, m in (("b", 2), ("a", 2), ("c", 3))]
    assert [r.id for r in select.ranked(spark.createDataFrame(rows, _ITEM)).orderBy("rank").collect()] == ["c", "a", "b"]


def test_gate_order(spark):
    items = spark.createDataFrame([("i1", "u1"), ("i2", "u2")], "id string, canonical_url string")
    e = lambda k, item, url, head="h", s="s": ("d", k, item, url, head, s, "", None, 1)
    rows = [e(0, "i1", "ux"), e(1, "zz", "u1"), e(2, "i2", "u1"), e(3, "i1", "u1", "　"), e(4, "i1", "u1", "h", "望ましい"), e(5, "i1", "u1"), e(6, "i1", "u1"), e(7, "i2", "u2")]
    entries = spark.createDataFrame(rows, "digest_id string, idx int, item_id string, source_url string, headline string, summary string, affected string, date_note string, importance_rank int")
    checked = gate.static_check(items, entries)
    assert [r.failed for r in checked.orderBy("idx").collect()] == ["Q1", "Q3", "Q3", "Q4", "Q5", None, "Q8", None]
    reached = spark.createDataFrame([("u1", False, False), ("u2", False, True)], "source_url string, ok boolean, robots_disallowed boolean")
    assert [r.failed for r in gate.reachability_check(checked, reached).orderBy("idx").collect()][5:] == ["Q2", "Q8", None]


T = message.Template()


def _format(entries, omitted):
    blocks = [T.header + "x"]
    for k, e in enumerate(entries, 1):
        lines = [f"{T.bullet}{k}. {T.mark if e[4] == 3 else ''}{e[2]}", T.indent + e[3], f"{T.indent}{T.source}{e[5]}"]
        blocks.append("\n".join(lines))
    if omitted:
        blocks.append(f"{T.omitted_before}{omitted}{T.omitted_after}")
    return "\n\n".join([*blocks, T.closing])


def _fit_loop(entries, omitted, limit):
    kept = list(entries)
    while len(_format(kept, omitted + len(entries) - len(kept))) > limit and len(kept) > 1:
        worst = max(range(len(kept)), key=lambda k: (-kept[k][4], k))
        kept.pop(worst)
    return _format(kept, omitted + len(entries) - len(kept)), kept


def test_fit_matches_dropping_one_by_one(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(40):
        es = [(d, k, "h" * rng.randint(1, 40), "s" * rng.randint(1, 80), rng.randint(1, 3), "u" * rng.randint(5, 30)) for k in range(rng.randint(1, 14))]
        rows += es
        want[d] = _fit_loop(es, d % 3, 600)
    df = spark.createDataFrame(rows, "digest_id int, idx int, headline string, summary string, importance_rank int, source_url string").withColumns({"affected": F.lit(""), "date_note": F.lit(None).cast("string")})
    for r in message.fit(df, T, F.lit(T.header + "x"), F.col("digest_id") % 3, 600).collect():
        assert (r.message, r.n_kept) == (want[r.digest_id][0], len(want[r.digest_id][1]))


def test_fit_cuts_a_lone_entry(spark):
    df = spark.createDataFrame([(0, 0, "h", "s" * 900, 1, "u")], "digest_id int, idx int, headline string, summary string, importance_rank int, source_url string").withColumns({"affected": F.lit(""), "date_note": F.lit(None).cast("string")})
    m = message.fit(df, T, F.lit("x"), F.lit(0), 300).first().message
    assert len(m) == 300 and "s…" in m and m.endswith(T.closing)


def test_ops_body(spark):
    lines = F.array(*(F.lit(f"l{k}") for k in range(25)))
    assert spark.range(1).select(message.ops_body(lines)).first()[0].endswith("l19\n... 5 more")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("feo")), min_size=1, max_size=60))
def test_streaks_match_the_state_machine(spark, log):
    rows = [(s, datetime(2024, 1, 1), k, o == "f", o == "e") for k, (s, o) in enumerate(log)]
    df = spark.createDataFrame(rows, "source_id long, ts timestamp_ntz, seq long, failed boolean, empty boolean")
    got = {r.seq: (r.failures, r.empties) for r in health.streaks(df).collect()}
    states, alerts = {}, {}
    for s, _, k, failed, empty in rows:
        states[s], alerts[k], _ = step(states.get(s, (0, 0, 0, 0)), failed, empty)
        want = states[s]
        assert got[k] == (want[0], want[1])


def test_alert_lengths(spark):
    got = [r.id for r in spark.range(1, 50).where(health.alerts_at(F.col("id"), 3)).collect()]
    assert got == [3, 6, 12, 24, 48]


def test_run_status(spark):
    row = lambda job, *x: spark.range(1).select(health.run_status(job, *map(F.lit, x))).first()[0]
    assert [row("collect", 0, 0, 0, 0), row("summarize", 0, 0, 0, 0), row("collect", 2, 1, 0, 0), row("deliver", 2, 0, 0, 1), row("deliver", 2, 0, 1, 1)] == ["failed", "succeeded", "partial", "failed", "partial"]


def test_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    df = lambda rows: spark.createDataFrame(rows, "id string, v int, version int")
    assert s.read("t") is None
    s.upsert("t", df([("a", 1, 1), ("b", 1, 1)]))
    s.upsert("t", df([("a", 2, 2), ("b", 0, 0), ("c", 5, 1)]))
    assert sorted(map(tuple, s.read("t").collect())) == [("a", 2, 2), ("b", 1, 1), ("c", 5, 1)]
    assert [r.id for r in store.multi_get(s.read("t"), ["c", "x", "a", "c"]).collect()] == ["c", "a"]


def test_delivery_decisions(spark):
    d = spark.createDataFrame([("a", None), ("b", "generated"), ("c", "approved"), ("e", "generated")], "id string, status string")
    sent = spark.createDataFrame([("e", "sent")], "id string, delivery_status string")
    got = {r.id: r.decision for r in delivery.decision(d, sent, F.col("id") != "e").collect()}
    assert got == {"a": "missing", "b": "awaiting_approval", "c": "send", "e": "already_sent"}


def test_config_violations(spark):
    rows = [("ok_1", "n", "html", "https://e.com", ["c"], ("a",), None), ("Bad", "", "feed", "ftp://x", [], ("a",), None)]
    s = spark.createDataFrame(rows, "id string, name string, type string, url string, channels array<string>, html struct<item_selector: string>, law struct<lookback_days: int>")
    got = sorted(tuple(r) for r in config.source_violations(s).collect())
    assert got == sorted(("Bad", v) for v in ("id pattern", "name empty", "url not http", "no channels", "html block not allowed"))


def test_model_results(spark):
    from tidemark.operators import model

    body = '[{"id":"a","channels":["m","x","m"],"relevance":7,"importance":"high","deadline":"2026-02-30","reason":" r\\n s "},{"id":"a","relevance":0}]'
    got = model.parse(spark.createDataFrame([(0, body), (1, "no json"), (2, None)], "batch_id int, body string"), ["m", "n"]).collect()
    assert [(r.id, r.channels, r.relevance, r.importance_rank, r.deadline, r.reason) for r in got] == [("a", ["m"], 1.0, 3, None, "r s")]
    asked = spark.createDataFrame([(0, "a"), (0, "b")], "batch_id int, id string")
    results = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.5)], "batch_id int, id string, relevance double")
    assert tuple(model.missing(model.join_results(asked, results)).first()) == (0, 2, 1)
    assert model.usage(spark.createDataFrame([], "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long")).first()[0] is None


def test_run_log(spark, tmp_path):
    from tidemark.operators import runs

    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    runs.begin(s, "r1", "collect", datetime(2026, 9, 13))
    assert s.read("runs").first().status == "running"
    runs.finish(s, "r1", "partial", datetime(2026, 9, 13, 1), {"fetched": 3}, ["e"])
    (r,) = s.read("runs").collect()
    assert (r.status, r.fetched, r.errors, r.started_at) == ("partial", 3, ["e"], datetime(2026, 9, 13))


def test_repairs_stop_above_half(spark):
    v = spark.createDataFrame([("a", "unset"), ("b", "ok"), ("c", "ok")], "id string, verdict string")
    assert [r.id for r in config.to_disable(v).collect()] == ["a"]
    assert config.to_disable(v.where("id <> 'c'")).count() == 1 and config.to_disable(v.where("id = 'a'")).count() == 0


def test_urgent_fit_drops_from_the_end(spark):
    df = spark.createDataFrame([(0, k, f"h{k}", "s" * 50, 1 + k % 3, "u") for k in range(9)], "digest_id int, idx int, headline string, summary string, importance_rank int, source_url string").withColumns({"affected": F.lit(""), "date_note": F.lit(None).cast("string")})
    r = message.fit_urgent(df, T, F.lit("x"), 500).first()
    assert r.n_kept < 9 and f"h{r.n_kept - 1}" in r.message and f"h{r.n_kept}" not in r.message
