"""Candidate lists: gates, life cycles, admission rules, episodes and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.stats import along, reasons
from barloom.operators.asof import as_of_join


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _num(column: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(float(default)))


def fundamental_points(rows: DataFrame) -> DataFrame:
    """Up to 20 points for growth and margins, 10 where nothing is known.

    Rows have fundamental_status, revenue_yoy, pat_yoy, opm_change,
    profit_quarters and margin_quarters.
    """
    rev, pat, opm = F.col("revenue_yoy"), F.col("pat_yoy"), F.col("opm_change")
    rules = [(rev > 0, 5), (rev > 10, 3), (pat > 0, 5), (opm > 0, 3), (F.col("profit_quarters") >= 3, 2), (F.col("margin_quarters") >= 2, 2)]
    points = sum((F.when(c, n).otherwise(0) for c, n in rules), F.lit(0))
    missing = F.upper(F.coalesce("fundamental_status", F.lit("MISSING"))) == "MISSING"
    return rows.withColumns({"fundamental_score": F.when(missing, 10).otherwise(F.least(points, F.lit(20))), "fa_missing": missing, "fa_improvement": _is(rev > 0) | _is(pat > 0) | _is(opm > 0), "fa_trigger_confirmed": _is(pat > 15) | _is(rev > 20)})


def final_gate(rows: DataFrame, least: float = 55) -> DataFrame:
    """Rows of conviction without a trap, with thesis and the level that would refute it.

    Rows have final_score, verdict, hard_trap_flag, credible_trigger,
    trigger_reason, move_tag, sector, invalidation_price, low and close.
    """
    verdict = F.upper(F.coalesce("verdict", F.lit("")))
    kept = rows.filter((_num("final_score") >= least) & verdict.isin("MEDIUM_CONVICTION", "HIGH_CONVICTION") & ~_is(F.col("hard_trap_flag")) & (_is(F.col("credible_trigger")) | (verdict == "HIGH_CONVICTION")))
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    trigger = F.coalesce(text("trigger_reason"), F.lit("investigator trigger"))
    move = F.when(text("move_tag") != trigger, text("move_tag"))
    score = F.format_string("score %.2f", F.col("final_score").cast("double"))
    source = F.when(F.col("invalidation_price").isNotNull(), "invalidation_price").when(F.col("low").isNotNull(), "low").when(F.col("close").isNotNull(), "close_7pct_fallback").otherwise("manual_review")
    return kept.withColumns({"thesis": F.concat_ws("; ", trigger, move, F.concat(F.lit("sector "), text("sector")), score, F.coalesce(text("verdict"), F.lit("review"))), "invalidation_level": F.coalesce("invalidation_price", "low", F.col("close") * 0.93), "invalidation_source": source, "gate_status": F.lit("PENDING")})


def lifecycle(rows: DataFrame) -> DataFrame:
    """Status of each tracked row and, where it is dropped, the first reason that holds; unknown marks do not hold.

    Rows have verdict, final_score, composite, appearances, days_since_seen,
    price_progression_pct, rank_change_20d, sector_support_score,
    sector_cluster_count, trigger_reason and the marks named below.
    """
    mark = lambda c: _is(F.col(c))
    seen, days, moved, rank, score = _num("appearances", 1), _num("days_since_seen"), _num("price_progression_pct"), _num("rank_change_20d"), _num("final_score")
    backed = (_num("sector_support_score") > 0) | mark("sector_rotation")
    several = _is(F.upper("trigger_reason").isin("WEEKLY_GAINER", "STEALTH_ACCUMULATION"))
    keep = (score >= 55) | (seen >= 3) | (moved > 0) | (rank < 0) | mark("sector_rotation") | mark("fa_trigger_confirmed")
    ladder = [
        (_is(F.col("verdict") == "NOISE_TRAP"), "NOISE_TRAP", True),
        (mark("long_upper_wick_trap"), "LONG_UPPER_WICK_TRAP", True),
        (mark("low_delivery_flag") & (seen <= 1) & (days > 0), "LOW_DELIVERY_NO_REPEAT", True),
        (_is(F.col("composite") < 35) & ~mark("credible_trigger"), "LOW_RANK_NO_NEWS", True),
        ((days >= 5) & (seen <= 1) & (moved < 0) & ~mark("credible_trigger") & ~backed & ~several, "ONE_CANDLE_DRAMA", False),
        ((days >= 10) & (seen < 2) & mark("volume_declining") & ~mark("volume_escalation") & (rank >= 0), "STALE_NO_REPEAT", False),
        ((days >= 20) & (seen < 3) & ~mark("fa_improvement") & (_num("sector_cluster_count") < 3) & ~keep, "FAILED_FOLLOW_THROUGH", True),
    ]
    reason, gone = F.lit(""), F.lit(None).cast("string")
    for condition, name, archived in reversed(ladder):
        reason, gone = F.when(condition, name).otherwise(reason), F.when(condition, "ARCHIVED" if archived else "DROPPED").otherwise(gone)
    active = F.when(F.col("verdict") == "HIGH_CONVICTION", "HIGH_CONVICTION").when((score >= 55) | mark("high_priority_repeat"), "ACTIVE_RESEARCH").when(F.col("verdict") == "WATCH_ONLY", "WATCHLIST").when(seen <= 1, "NEW_TRIGGER").otherwise("TRACKING")
    return rows.withColumns({"drop_reason": reason, "status": F.coalesce(gone, active)})


def exit_monitoring(gate: DataFrame, bars: DataFrame) -> DataFrame:
    """What became of each gated row: days since, breach of its level, three-session follow-through and the reason to leave.

    Gate rows have symbol_id, entry_date, final_score and invalidation_level. One
    as-of join finds the bar at or before the entry, which knows the closes of
    the four bars after it, the last bar of its symbol and its own number.
    """
    w, whole = along(), Window.partitionBy("symbol_id")
    known = bars.select("symbol_id", "trade_date", F.col("close").alias("_c0"), *[F.lead("close", k).over(w).alias(f"_c{k}") for k in range(1, 5)], F.row_number().over(w).alias("_n"), F.count(F.lit(1)).over(whole).alias("_all"), F.max(F.struct("trade_date", "close")).over(whole).alias("_last"))
    rows = as_of_join(gate, known, "symbol_id", "entry_date", "trade_date", ["_c0", "_c1", "_c2", "_c3", "_c4", "_n", "_all", "_last"])
    on_day = F.col("matched_at") == F.col("entry_date")
    after = F.col("_all") - F.col("_n") + on_day.cast("int")
    rows = rows.withColumn("_after", F.when(after > 0, after))
    seen = F.col("_after").isNotNull()
    close, held = F.col("_last.close"), F.col("_c0")
    best = F.greatest("_c1", "_c2", "_c3", F.when(~on_day, F.col("_c4")))
    follow = F.when(~seen | close.isNull() | held.isNull(), "UNKNOWN").when(F.col("_after") < 4, "PENDING_3D").when(_is(best > held) & (close >= held), "CONFIRMED").otherwise("FAILED_3D")
    rows = rows.withColumns({"days_since_entry": F.when(seen, F.datediff("_last.trade_date", "entry_date")), "latest_close": F.when(seen, close), "followthrough": follow}).withColumn("breached", F.when(seen, _is(F.col("latest_close") < F.col("invalidation_level"))))
    reason = F.when(F.col("breached"), "INVALIDATION_BREACH").when(F.col("followthrough") == "FAILED_3D", "FAILED_3D_FOLLOWTHROUGH").when(F.col("final_score") < 55, "SCORE_BELOW_55").when(F.col("followthrough") == "UNKNOWN", "UNKNOWN_DATA").otherwise("NONE")
    return rows.withColumn("exit_reason", reason).withColumn("exit_triggered", ~F.col("exit_reason").isin("NONE", "UNKNOWN_DATA")).select(*gate.columns, "days_since_entry", "latest_close", "breached", "followthrough", "exit_triggered", "exit_reason")


def scan_view(ranked: DataFrame, pattern: DataFrame, breakout: DataFrame) -> DataFrame:
    """Ranked symbols with their best pattern and breakout, and unranked ones that either scan found.

    All have one row per symbol; patterns have pattern_score, breakouts have
    breakout_score, and each may have close and rel_strength, of which the
    first known counts. ``scan_group`` is 0 for ranked rows, 1 for those of the
    pattern scan, 2 for those of the breakout scan alone.
    """
    shared = ["close", "rel_strength"]
    a = ranked.select("symbol_id", "rank", "composite", *shared)
    b = pattern.select("symbol_id", "pattern_score", "pattern_positive", *[F.col(c).alias(f"_p_{c}") for c in shared])
    c = breakout.select("symbol_id", "breakout_score", "breakout_positive", *[F.col(x).alias(f"_b_{x}") for x in shared])
    rows = a.join(b, "symbol_id", "full_outer").join(c, "symbol_id", "full_outer")
    rows = rows.withColumns({x: F.coalesce(x, f"_p_{x}", f"_b_{x}") for x in shared} | {k: _is(F.col(k)) for k in ("pattern_positive", "breakout_positive")})
    group = F.when(F.col("rank").isNotNull(), 0).when(F.col("pattern_positive"), 1).when(F.col("breakout_positive"), 2)
    return rows.withColumns({"scan_group": group, "discovered_by_pattern": F.col("rank").isNull() & F.col("pattern_positive")}).filter("scan_group is not null").drop(*[f"_{k}_{x}" for k in "pb" for x in shared])


def admission(rows: DataFrame) -> DataFrame:
    """All admission rules that a row passes, in order of precedence, the one that counts and its setup family.

    Rows have review_eligible, thesis_eligible, breakout_score, breakout_tier,
    provisional_stage, stage_confidence, lifecycle_hint, accumulation_score,
    evidence_score, verdict, pattern_score, rank_velocity and rank_percentile.
    """
    c = F.col
    #: Fixed order, limits and families of the rules.
    rules = [
        ("investigator_primary_onset", "investigator_primary", c("review_eligible")),
        ("fundamental_thesis", "fundamental_thesis", c("thesis_eligible")),
        ("qualified_breakout", "breakout", (c("breakout_score") >= 80) & ((c("breakout_tier") == "A") | c("breakout_tier").isNull())),
        ("stage_transition", "stage_1_to_2_transition", (c("provisional_stage") == "transition_1_to_2") & (c("stage_confidence") >= 75)),
        ("early_accumulation", "early_accumulation", _is(c("lifecycle_hint") == "early_accumulation") | _is(c("accumulation_score") >= 75)),
        ("investigator_promotion", "base_building", (c("evidence_score") >= 70) & c("verdict").isin("HIGH_CONVICTION", "MEDIUM_CONVICTION")),
        ("qualified_pattern", "base_building", c("pattern_score") >= 80),
        ("rank_velocity", "momentum_leader", (c("rank_velocity") <= -5) & (c("rank_percentile") >= 75)),
        ("rank_threshold", "momentum_leader", c("rank_percentile") >= 90),
    ]
    passed = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(name).alias("rule"), F.lit(family).alias("family"))) for name, family, ok in rules]))
    return rows.withColumn("_r", passed).withColumns({"rules": F.concat_ws(",", F.transform("_r", lambda x: x["rule"])), "chosen_rule": F.get("_r", F.lit(0))["rule"], "setup_family": F.get("_r", F.lit(0))["family"]}).drop("_r")


def entry_guard(rows: DataFrame, confidence: float = 75, evidence: float = 80, size: float = 0.35) -> DataFrame:
    """Blockers of an early entry and the size it is allowed; a row without blockers passes, what is unknown blocks.

    Rows have stage_status, provisional_stage, confidence, sector_status,
    sector_stage, sector_strength, lifecycle_state, evidence_score,
    extension_risk and market_regime.
    """
    need = [
        (F.col("stage_status") == "PROVISIONAL", "stock_not_provisional"),
        (F.col("provisional_stage") == "transition_1_to_2", "stock_not_in_transition"),
        (F.col("confidence") >= confidence, "stock_confidence"),
        (F.col("sector_status") == "LOCKED", "sector_not_locked"),
        (F.col("sector_stage") == "stage_2_advancing", "sector_not_stage_2"),
        (F.lower(F.trim("sector_strength")) == "improving", "sector_not_improving"),
        (F.col("lifecycle_state") == "READY", "not_ready"),
        (F.col("evidence_score") >= evidence, "evidence"),
        (F.col("extension_risk") == "LOW", "extension_risk"),
        (F.lower(F.trim("market_regime")).isin("cautious_bull", "bull", "strong_bull"), "market_regime"),
    ]
    blockers = reasons(*[(~_is(ok), name) for ok, name in need])
    passed = F.size(blockers) == 0
    return rows.withColumns({"blockers": F.concat_ws(",", blockers), "passed": passed, "eligibility": F.when(passed, "CONDITIONALLY_ELIGIBLE").otherwise("BLOCKED"), "max_size": F.when(passed, size).otherwise(0.0)})


#: Fixed order in which a setup may progress.
PROGRESSION = ("early_accumulation", "base_building", "stage_1_to_2_transition", "breakout", "post_breakout_followthrough")


def match_episodes(signals: DataFrame, episodes: DataFrame, days: int = 30) -> DataFrame:
    """The open episode that a signal belongs to: the same family, one that progressed, one it supersedes, a conflict, or none.

    Signals have signal_id, symbol_id, family and as_of; episodes, open ones,
    have episode_id, symbol_id, episode_family and last_at. A symbol has at most
    a few open episodes, so the join stays near the size of the signals.
    """
    step = lambda c: F.array_position(F.array(*map(F.lit, PROGRESSION)), F.col(c))
    both = signals.join(episodes, "symbol_id", "left")
    exact = F.col("episode_family") == F.col("family")
    near = (step("family") > 0) & (step("episode_family") > 0) & (step("episode_family") <= step("family")) & F.datediff("as_of", "last_at").between(0, days)
    older = (F.col("family") == "breakout") & (F.col("episode_family") == "momentum_leader")
    of = lambda ok: (F.count_if(ok), F.min(F.when(ok, F.col("episode_id"))))
    (n_exact, id_exact), (n_near, id_near), (n_older, id_older) = of(exact), of(near), of(older)
    per = both.groupBy("signal_id", "symbol_id", "family", "as_of").agg(n_exact.alias("_e"), id_exact.alias("_ei"), n_near.alias("_n"), id_near.alias("_ni"), n_older.alias("_o"), id_older.alias("_oi"), F.count("episode_id").alias("_all"))
    outcome = F.when(F.col("_e") == 1, "EXACT").when(F.col("_e") > 1, "CONFLICT").when(F.col("_n") == 1, "PROGRESSION").when((F.col("_all") == 1) & (F.col("_o") == 1), "SUPERSEDES").when(F.col("_all") > 0, "CONFLICT").otherwise("NEW_EPISODE")
    per = per.withColumn("outcome", outcome)
    found = F.when(F.col("outcome") == "EXACT", F.col("_ei")).when(F.col("outcome") == "PROGRESSION", F.col("_ni")).when(F.col("outcome") == "SUPERSEDES", F.col("_oi"))
    return per.select("signal_id", "symbol_id", "family", "as_of", "outcome", found.alias("episode_id"))


def constituents(members: DataFrame, stages: DataFrame, ranks: DataFrame, sector: str, limit: int) -> DataFrame:
    """Latest members of a sector with their stage and rank, the best ranked first (a top list)."""
    rows = members.filter(F.col("sector") == sector).join(stages, "symbol_id", "left").join(ranks, "symbol_id", "left")
    return rows.orderBy(F.col("rank").asc_nulls_last(), "symbol_id").limit(limit)


#: Fixed names of the buckets of a watchlist.
BUCKETS = ("TRIGGERED_TODAY", "CORE_MOMENTUM", "EARLY_STAGE2", "AVOID_WEAK_CONFIRMATION")


def watchlist_warnings(rows: DataFrame) -> DataFrame:
    """One row per broken contract of a watchlist and how many rows break it; duplicates count from the second row.

    Rows have symbol_id, rank, watchlist_score, trust_status, bucket,
    operator_action and gate_status.
    """
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.lit(0))) > 1
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    marked = rows.withColumns({"_s": F.col("symbol_id").isNotNull() & again("symbol_id"), "_k": again("rank")})
    checks = {
        "null symbol_id": F.col("symbol_id").isNull(),
        "duplicate symbol_id": F.col("_s"),
        "duplicate rank": F.col("_k"),
        "watchlist_score outside 0 to 100": ~_is(F.col("watchlist_score").between(0, 100)),
        "blocked trust_status": _is(F.lower("trust_status") == "blocked"),
        "unknown bucket": (text("bucket") != "") & ~text("bucket").isin(*BUCKETS),
        "empty operator_action": text("operator_action") == "",
        "unknown gate_status": (text("gate_status") != "") & ~text("gate_status").isin("PASSED", "REJECTED"),
    }
    broken = F.explode(reasons(*[(ok, name) for name, ok in checks.items()]))
    return marked.select(broken.alias("warning")).groupBy("warning").agg(F.count("*").alias("n_rows"))
