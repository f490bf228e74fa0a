"""Drawdown states of equity curves, model switches with hysteresis, latches and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Pieces, ratio, with_carries
from ..session import materialize

#: Drawdown levels of the global state and multiplier.
LEVEL_1, LEVEL_2, LEVEL_3, LEVEL_4, EMERGENCY = 0.05, 0.10, 0.15, 0.20, 0.25
#: Fixed values: (reduced from, disabled from) per model; re-enabled below RECOVERY.
MODEL_LEVELS = {"scalp": (0.05, 0.08), "intraday": (0.10, 0.12), "swing": (0.15, 0.18)}
RECOVERY = LEVEL_1 * 0.5
STATES = ("full_risk", "reduced_risk", "minimal_risk", "risk_off", "emergency")


def risk_state(dd: Column) -> Column:
    return (F.when(dd >= EMERGENCY, STATES[4]).when(dd >= LEVEL_4, STATES[3]).when(dd >= LEVEL_3, STATES[2])
            .when(dd >= LEVEL_1, STATES[1]).otherwise(STATES[0]))


def multiplier(dd: Column) -> Column:
    """Piecewise linear: 1, .75, .50, .25 at the levels, 0 from the fourth on."""
    step = lambda top, lo, hi: top - 0.25 * (dd - lo) / (hi - lo)
    return (F.when(dd < LEVEL_1, F.lit(1.0)).when(dd < LEVEL_2, step(1.0, LEVEL_1, LEVEL_2))
            .when(dd < LEVEL_3, step(0.75, LEVEL_2, LEVEL_3)).when(dd < LEVEL_4, step(0.5, LEVEL_3, LEVEL_4)).otherwise(F.lit(0.0)))


def step_scale(dd: Column) -> Column:
    """Step form of the multiplier."""
    return (F.when(dd < 0.05, F.lit(1.0)).when(dd < 0.10, F.lit(0.75)).when(dd < 0.15, F.lit(0.5)).when(dd < 0.20, F.lit(0.25)).otherwise(F.lit(0.0)))


def warning_multiplier(dd: Column, warn: float = 0.05, critical: float = 0.10, emergency: float = 0.15) -> Column:
    """Second-engine form: 1, then down to .5, then .25, then 0."""
    return (F.when(dd < warn, F.lit(1.0)).when(dd < critical, 1 - 0.5 * (dd - warn) / (critical - warn))
            .when(dd < emergency, F.lit(0.25)).otherwise(F.lit(0.0)))


def engine_state(dd: Column) -> Column:
    return F.when(dd >= 0.15, "OFF").when(dd >= 0.10, "REDUCED").otherwise("ON")


def equity_states(equity: DataFrame, initial: float = 10_000.0, keys=("account",), pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Per equity row: peak, drawdowns, duration, recovery, velocity, states, multiplier, latch.

    ``equity`` is indexed per account.  An ``epoch`` column (number of manual resets so far) may be
    among ``keys``: every epoch starts with a fresh peak.  Model states follow in closed form:
    the largest drawdown since the last full recovery decides.
    """
    s = Pieces(equity, keys=keys, pos=pos, halo=16, rows=rows)
    p = F.col(pos)
    s.running_from(equity, _top=("max", F.col("equity")))
    s.stage(peak_equity=F.greatest(F.col("_top"), F.lit(initial)))
    s.stage(current_drawdown=F.when(F.col("peak_equity") > 0, ratio(F.col("peak_equity") - F.col("equity"), "peak_equity")).otherwise(0.0))
    dd = F.col("current_drawdown")
    four_back = F.when(p >= 4, s.lag("equity", 4)).when(p == 3, F.lit(initial))
    s.stage(drawdown_velocity=F.coalesce(ratio(four_back - F.col("equity"), F.col("peak_equity") * 4), F.lit(0.0)))
    t = _since_reset(s, keys, pos, dd < RECOVERY, {"peak_pos": F.when(dd <= 0, p), "latched": (dd >= EMERGENCY).cast("int")})
    worst = F.col("worst")
    return t.withColumns({
        "drawdown_duration": p - F.coalesce(F.col("peak_pos"), F.lit(-1)),
        "recovery_ratio": F.when(F.col("max_drawdown") > 0, 1 - ratio(dd, "max_drawdown")).otherwise(1.0),
        "risk_state": risk_state(dd), "risk_multiplier": multiplier(dd), "emergency": F.col("latched") == 1,
        **{f"{m}_state": F.when(worst >= off, "disabled").when(worst >= low, "reduced").otherwise("enabled") for m, (low, off) in MODEL_LEVELS.items()},
    }).drop("peak_pos", "latched", "worst")


def _since_reset(s: Pieces, keys, pos: str, reset: Column, tops: dict[str, Column]):
    """Adds ``max_drawdown``, ``worst`` (largest drawdown since the last row where ``reset`` holds) and the running maxima ``tops``.

    Values inside the piece are written once; the states before the pieces come from one aggregate over that table.
    """
    dd = F.col("current_drawdown")
    tops = {"max_drawdown": dd, **tops}
    s.stage(**{n: s.inside("max", x) for n, x in tops.items()}, last_reset=F.coalesce(s.inside("max", F.when(reset, F.col(pos))), F.lit(-1)))
    s.stage(since=s.inside("max", F.struct(F.col("last_reset").cast("long").alias("r"), dd.alias("d"))))
    t = with_carries(materialize(s.close(), "states"), keys, {**{f"_c_{n}": ("max", F.col(n)) for n in tops}, "_c_since": ("since", F.col("since"))}, s.rows, pos)
    worst = F.when(F.col("since.r") >= 0, F.col("since.d")).otherwise(F.greatest(F.col("_c_since.d"), F.col("since.d")))
    return t.withColumns({**{n: F.greatest(f"_c_{n}", n) for n in tops}, "worst": worst}).drop("since", "last_reset", "_c_since", *[f"_c_{n}" for n in tops])


def engine_equity_states(equity: DataFrame, keys=("account",), pos: str = "pos", rows: int | None = None) -> DataFrame:
    """Second engine: peak of the data only, 5/10/15 % levels, disabling with re-enable below 5 %."""
    s = Pieces(equity, keys=keys, pos=pos, halo=16, rows=rows)
    s.running_from(equity, peak_equity=("max", F.greatest(F.col("equity"), F.lit(0.0))))
    s.stage(current_drawdown=F.when(F.col("peak_equity") > 0, ratio(F.col("peak_equity") - F.col("equity"), "peak_equity")).otherwise(0.0))
    dd, worst = F.col("current_drawdown"), F.col("worst")
    t = _since_reset(s, keys, pos, dd < 0.05, {})
    return t.withColumns({"engine_state": engine_state(dd), "dd_multiplier": warning_multiplier(dd), "scalp_disabled": worst > 0.10,
                          "intraday_disabled": worst > 0.15, "swing_disabled": F.lit(False)}).drop("worst")


def auto_kill(equity: DataFrame, keys=("account",), pos: str = "pos", max_dd: float = 0.20, max_losses: int = 5,
              max_daily_loss: float = 0.05, rows: int | None = None) -> DataFrame:
    """Kill switch that latches on drawdown, consecutive losses or the loss of a day.

    Needs ``equity``, ``pnl`` and ``day_start_equity`` per row.
    """
    s = Pieces(equity, keys=keys, pos=pos, halo=16, rows=rows)
    s.running_from(equity, _peak=("max", F.col("equity")), _win=("max", F.when(F.col("pnl") > 0, F.col(pos))))
    losses = F.col(pos) - F.coalesce("_win", F.lit(-1))
    day = ratio(F.col("day_start_equity") - F.col("equity"), "day_start_equity")
    s.stage(consecutive_losses=losses, drawdown=ratio(F.col("_peak") - F.col("equity"), "_peak"), daily_loss=day)
    hit = (F.col("drawdown") > max_dd) | (losses > max_losses) | F.coalesce(day > max_daily_loss, F.lit(False))
    s.stage(trigger=hit)
    s.stage(fired=s.inside("max", F.col("trigger").cast("int")))
    t = with_carries(materialize(s.close(), "switches"), keys, {"_c": ("max", F.col("fired"))}, s.rows, pos)
    return t.withColumn("kill_switch", F.greatest("_c", "fired") == 1).drop("_c", "fired")


def state_events(states: DataFrame, keys=("account",), pos: str = "pos", rows: int | None = None) -> DataFrame:
    """One row per change of the global state or of a model state."""
    names = ["risk_state", *[f"{m}_state" for m in MODEL_LEVELS]]
    first = {"risk_state": STATES[0], **{f"{m}_state": "enabled" for m in MODEL_LEVELS}}
    s = Pieces(states, keys=keys, pos=pos, halo=16, rows=rows)
    s.stage(**{f"was_{n}": F.when(F.col(pos) == 0, F.lit(first[n])).otherwise(s.lag(n)) for n in names})
    item = lambda n: F.when(F.col(n) != F.col(f"was_{n}"), F.struct(
        F.lit(n.removesuffix("_state")).alias("what"), F.col(f"was_{n}").alias("from_state"), F.col(n).alias("to_state")))
    out = s.close().withColumn("e", F.explode(F.array_compact(F.array(*[item(n) for n in names]))))
    return out.select(*keys, pos, "e.what", "e.from_state", "e.to_state", "current_drawdown", "equity")


def state_features(states: DataFrame) -> DataFrame:
    """Drawdown state as model inputs."""
    code = F.array_position(F.array(*[F.lit(x) for x in STATES]), F.col("risk_state")).cast("int") - 1
    count = lambda v: sum(((F.col(f"{m}_state") == v).cast("int") for m in MODEL_LEVELS), F.lit(0))
    return states.withColumns({
        "dd_current": F.col("current_drawdown"), "dd_max": F.col("max_drawdown"), "dd_velocity": F.col("drawdown_velocity"),
        "dd_risk_multiplier": F.col("risk_multiplier"), "dd_risk_state": code, "dd_models_enabled": count("enabled"),
        "dd_models_disabled": count("disabled"), "kill_switch": F.col("emergency").cast("double")})
