"""Maintenance policy as table work.

The reference learns a Q-table by sampled epsilon-greedy steps. Here the
same model is reduced on Spark to transition probabilities per (state,
action) — from logged telemetry (D2) or from the uniform degradation /
repair model in closed form (D2b) — and the <= 16-cell Bellman fixed point
is iterated on the driver (deterministic, exact to 1e-12), then returned
as a small broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.expressions import wear_state
from wearline.operators.chunks import CHUNK_ROWS, chunk_window, chunked, own_rows
from wearline.operators.labels import unit_keys
from wearline.schema import CYCLE, RUL, UNIT

# FIXED VALUES: rewards of the reference scheduler
FAILURE_COST = -100
MAINTENANCE_COST = -10
NO_ACTION_COST = -1
# actions the reward/transition rules know; the reference config lists
# ["no_maintenance", "maintenance"], and "maintenance" falls to the default rule
ACTIONS = ["no_maintenance", "immediate_maintenance", "schedule_maintenance"]
CONFIG_ACTIONS = ["no_maintenance", "maintenance"]
# next-RUL intervals per action: degrade by U(1,10); repairs add U(20,50) / U(10,30)
DEGRADE = (-10.0, -1.0)
REPAIR = {"immediate_maintenance": (20.0, 50.0), "schedule_maintenance": (10.0, 30.0)}
# state bands on RUL: (lo, hi]
BANDS = {"healthy": (100.0, None), "moderate_wear": (50.0, 100.0),
         "severe_wear": (20.0, 50.0), "failed": (None, 20.0)}


def reward(state, action, next_state) -> Column:
    """D1, in the reference's rule order (a failed next state first)."""
    s, a, n = (F.col(x) if isinstance(x, str) else x for x in (state, action, next_state))
    imm = F.when(s.isin("severe_wear", "failed"), MAINTENANCE_COST + 20).otherwise(MAINTENANCE_COST - 10)
    sch = (F.when(s == "moderate_wear", MAINTENANCE_COST + 10)
           .when(s == "severe_wear", MAINTENANCE_COST).otherwise(MAINTENANCE_COST - 5))
    none = (F.when(s == "healthy", 5).when(s == "moderate_wear", NO_ACTION_COST)
            .otherwise(FAILURE_COST / 2))
    return (F.when(n == "failed", F.lit(FAILURE_COST))
            .when(a == "immediate_maintenance", imm)
            .when(a == "schedule_maintenance", sch)
            .when(a == "no_maintenance", none)
            .otherwise(F.lit(NO_ACTION_COST))).cast("double")


def logged_steps(df: DataFrame, rul_col: str = RUL, action: str = "no_maintenance", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row: wear state now and at the next cycle of the unit, with the
    reward of the logged action (run-to-failure data: no maintenance). A long
    unit is cut into chunks that see the first row of the next one."""
    keys = unit_keys(df)
    st = wear_state(rul_col)
    c = chunked(df.select(*keys, CYCLE, F.col(rul_col)), keys, CYCLE, ahead=1, chunk_rows=chunk_rows)
    out = own_rows(c.select("*", st.alias("state"), F.lead(st, 1).over(chunk_window(keys, CYCLE)).alias("next_state")))
    return (out.select(UNIT, CYCLE, F.col(rul_col).alias(RUL), "state", "next_state")
            .withColumn("action", F.lit(action))
            .withColumn("reward", reward("state", "action", "next_state")))


def wear_transitions(df: DataFrame, rul_col: str = RUL, action: str = "no_maintenance") -> DataFrame:
    """Counts and mean reward per (state, action, next_state)."""
    s = logged_steps(df, rul_col, action).filter(F.col("next_state").isNotNull())
    return (s.groupBy("state", "action", "next_state")
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"), F.avg("reward").alias("mean_reward")))


def _interval(action: str):
    return REPAIR.get(action, DEGRADE)


def action_transitions(df: DataFrame, rul_col: str = RUL, actions=None) -> DataFrame:
    """P(next_state | state, action) for the uniform model, averaged
    over the RUL values of the data. Equal RUL values are grouped first;
    each distinct value then yields |actions| x 4 overlap fractions
    (``explode`` + partial aggregate)."""
    actions = actions or ACTIONS
    r = F.col("r")
    items = []
    for a in actions:
        d_lo, d_hi = _interval(a)
        for ns, (b_lo, b_hi) in BANDS.items():
            lo = r + d_lo if b_lo is None else F.greatest(r + d_lo, F.lit(b_lo))
            hi = r + d_hi if b_hi is None else F.least(r + d_hi, F.lit(b_hi))
            frac = F.greatest(hi - lo, F.lit(0.0)) / F.lit(d_hi - d_lo)
            items.append(F.struct(F.lit(a).alias("action"), F.lit(ns).alias("next_state"),
                                  frac.alias("p")))
    vals = (df.filter(F.col(rul_col).isNotNull())
            .groupBy(F.col(rul_col).cast("double").alias("r")).agg(F.count(F.lit(1)).alias("w")))
    ex = vals.select("w", wear_state("r").alias("state"), F.inline(F.array(*items)))
    out = (ex.groupBy("state", "action", "next_state")
           .agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("probability")))
    return out.withColumn("reward", reward("state", "action", "next_state"))


def solve_q(transitions: list[tuple], gamma: float = 0.9, terminal_states=(), sweeps: int = 300):
    """Bellman fixed point on the driver; ``transitions`` rows are
    (state, action, next_state, probability, reward) — at most 4 x |A| x 4
    entries. Synchronous sweeps from Q = 0."""
    sa = sorted({(s, a) for s, a, *_ in transitions})
    q = {k: 0.0 for k in sa}
    by = {}
    for s, a, n, p, r in transitions:
        by.setdefault((s, a), []).append((n, p, r))
    for _ in range(sweeps):
        best = {}
        for (s, a), v in q.items():
            best[s] = max(best.get(s, v), v)
        new = {}
        for (s, a) in sa:
            if s in terminal_states:
                new[(s, a)] = 0.0
                continue
            tot = 0.0
            for n, p, r in by[(s, a)]:
                nxt = 0.0 if n in terminal_states else best.get(n, 0.0)
                tot += p * (r + gamma * nxt)
            new[(s, a)] = tot
        q = new
    return q


def policy_values(transitions: DataFrame, gamma: float = 0.9, terminal_states=(),
                  sweeps: int = 300) -> DataFrame:
    """D3: Q(s, a) = sum_s' p (r + gamma max_a' Q(s', a')). The input has at
    most |states| x |actions| x |states| rows (bounded), so it is solved on
    the driver and returned as a small table."""
    rows = [(r["state"], r["action"], r["next_state"], float(r["probability"]), float(r["reward"]))
            for r in transitions.select("state", "action", "next_state", "probability", "reward").collect()]
    q = solve_q(rows, gamma, terminal_states, sweeps)
    spark = transitions.sparkSession
    return spark.createDataFrame([(s, a, float(v)) for (s, a), v in sorted(q.items())],
                                 "state string, action string, q double")


def greedy_policy(q: DataFrame, actions=None) -> DataFrame:
    """Best action per state; ties go to the first listed action."""
    actions = actions or ACTIONS
    order = F.array_position(F.array(*[F.lit(a) for a in actions]), F.col("action"))
    return (q.groupBy("state")
            .agg(F.max_by("action", F.struct(F.col("q"), -order)).alias("recommended_action"),
                 F.max("q").alias("value")))


def q_table_wide(q: DataFrame, actions=None) -> DataFrame:
    """One row per state, one column per action."""
    actions = actions or ACTIONS
    return q.groupBy("state").agg(*[F.max(F.when(F.col("action") == a, F.col("q"))).alias(a)
                                    for a in actions])


def maintenance_schedule(df: DataFrame, policy: DataFrame, rul_col: str = RUL) -> DataFrame:
    """Unit, cycle, RUL, state, recommended action. The policy has one
    row per state (<= 4): a bounded broadcast join."""
    pol = F.broadcast(policy.select("state", "recommended_action"))
    return (df.select(UNIT, CYCLE, F.col(rul_col).alias(RUL), wear_state(rul_col).alias("state"))
            .join(pol, "state", "left")
            .select(UNIT, CYCLE, RUL, "state", "recommended_action"))


def schedule_merge(predictions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Left equi-join on (unit, cycle)."""
    return predictions.join(schedule.select(UNIT, CYCLE, "state", "recommended_action"),
                            [UNIT, CYCLE], "left")


def block_average(steps: DataFrame, block: int = 100, value: str = "reward") -> DataFrame:
    """Mean per block of ``block`` consecutive cycles of each unit."""
    b = F.floor((F.col(CYCLE) - 1) / block).cast("bigint")
    return (steps.groupBy(UNIT, b.alias("block"))
            .agg(F.avg(value).alias("average_reward"), F.count(F.lit(1)).cast("bigint").alias("steps")))


def policy_from_mdp(spark: SparkSession, mdp: list[tuple], gamma: float = 0.9,
                    terminal_states=("failed",)) -> DataFrame:
    """The exploration notebook's deterministic MDP (state, action,
    next_state, reward) solved exactly."""
    rows = [(s, a, n, 1.0, float(r)) for s, a, n, r in mdp]
    q = solve_q(rows, gamma, terminal_states)
    return spark.createDataFrame([(s, a, float(v)) for (s, a), v in sorted(q.items())],
                                 "state string, action string, q double")

