"""Targets mapped to facts: units, precision, staged candidates, statuses; periods of targets; claims and releases."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label -> (factor, dimension, canonical).
REGISTRY: dict[str, tuple[Decimal, str, str]] = {
    "USD": (Decimal(1), "monetary", "USD"), "USD_thousand": (Decimal(1000), "monetary", "USD"), "USD_million": (Decimal(10**6), "monetary", "USD"), "USD_billion": (Decimal(10**9), "monetary", "USD"),
    "shares": (Decimal(1), "share_count", "shares"), "shares_thousand": (Decimal(1000), "share_count", "shares"), "shares_million": (Decimal(10**6), "share_count", "shares"), "shares_billion": (Decimal(10**9), "share_count", "shares"),
    "USD_per_share": (Decimal(1), "monetary_per_share", "USD_per_share"), "USD_per_basic_share": (Decimal(1), "monetary_per_share", "USD_per_share"), "USD_per_diluted_share": (Decimal(1), "monetary_per_share", "USD_per_share"),
    "pure": (Decimal(1), "ratio", "pure"), "percent": (Decimal("0.01"), "ratio", "pure"), "percentage_point": (Decimal(1), "percentage_point", "percentage_point"),
}


def compare_units(a: str, b: str) -> str:
    if a == b:
        return "exact_label_match"
    if a not in REGISTRY or b not in REGISTRY:
        return "unregistered_unit"
    return "registered_equivalence" if REGISTRY[a][1:] == REGISTRY[b][1:] else "dimension_mismatch"


def registry(spark: SparkSession) -> DataFrame:
    """(label, factor, dimension, canonical): a row for each registered unit."""
    return spark.createDataFrame([(k, float(f), d, c) for k, (f, d, c) in REGISTRY.items()], "label string, factor double, dimension string, canonical string")


def with_units(df: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """df with dimension, canonical and base_value (the value in canonical units); all null for a unit that isn't registered."""
    r = F.broadcast(registry(df.sparkSession))
    out = df.join(r, F.col(unit) == F.col("label"), "left").withColumn("base_value", F.col(value).cast("double") * F.col("factor"))
    return out.drop("label", "factor")


def unit_status(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with status: compare_units as a join with the registry."""
    side = lambda n: F.broadcast(registry(pairs.sparkSession).select(F.col("label").alias(f"_{n}"), F.struct("dimension", "canonical").alias(f"_k{n}")))
    out = pairs.join(side("x"), F.col(a) == F.col("_x"), "left").join(side("y"), F.col(b) == F.col("_y"), "left")
    status = F.when(F.col(a) == F.col(b), "exact_label_match").when(F.col("_kx").isNull() | F.col("_ky").isNull(), "unregistered_unit")
    status = status.when(F.col("_kx") == F.col("_ky"), "registered_equivalence").otherwise("dimension_mismatch")
    return out.withColumn("status", status).drop("_x", "_kx", "_y", "_ky")


def agrees(stated: Column, found: Column, precision: dict, both: bool = False) -> Column:
    """matches() over columns of doubles or decimals; a relative tolerance may be a Column."""
    if precision["mode"] == "ABS_TOLERANCE":
        return F.abs(stated - found) <= (precision["tolerance"] if isinstance(precision["tolerance"], Column) else F.lit(float(precision["tolerance"])))
    if precision["mode"] == "QUANTUM":
        step = lambda x: F.bround(x / F.lit(float(precision["quantum"])))
        return (step(stated) == step(found)) if both else (stated / F.lit(float(precision["quantum"])) == step(found))
    return stated == found


def comparison(stated: Column, found: Column, precision: dict) -> Column:
    """compare() over columns."""
    same = agrees(stated, found, precision)
    return F.when(same, "signed_equivalent").when(agrees(F.abs(stated), F.abs(found), precision), "opposite_sign_magnitude_only").otherwise("different")


def selected(variants: DataFrame, by: list[str], passed: str, order: list[str]) -> DataFrame:
    """One variant of each group: the first in order that passed, else the first."""
    w = Window.partitionBy(*by).orderBy(F.desc(passed), *order)
    return variants.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def lineage(required: DataFrame, found: DataFrame) -> DataFrame:
    """required (target_id, input_id) with the status of each input (target_id, status of found); inputs without one are `missing`, and a target is complete
    only if all its inputs are mapped."""
    each = required.join(found.select(F.col("target_id").alias("input_id"), "status"), "input_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    whole = each.groupBy("target_id").agg(F.count("*").alias("inputs"), F.count(F.when(F.col("status") == "mapped", 1)).alias("mapped"))
    return each.join(whole, "target_id").select("target_id", "input_id", "status", (F.col("inputs") == F.col("mapped")).alias("complete"))


def coverage(targets: DataFrame, candidates: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each target: its status, and how many candidates each stage gave it."""
    n = candidates.groupBy("target_id").agg(*[F.count(F.when(F.col("stage") == k, 1)).alias(f"stage{k}") for k in (1, 2, 3)])
    out = targets.select("target_id").join(found, "target_id", "left").join(n, "target_id", "left")
    return out.withColumns({f"stage{k}": F.coalesce(f"stage{k}", F.lit(0)) for k in (1, 2, 3)})


def in_base(value: str, unit: str) -> Decimal:
    with localcontext(Context(prec=100)):
        return Decimal(value) * REGISTRY[unit][0]


def precision_of(digits: int | None = None, tolerance: str | None = None) -> dict:
    """A tolerance, else a quantum of 10^-digits, else exact."""
    if tolerance is not None:
        return {"mode": "ABS_TOLERANCE", "tolerance": Decimal(tolerance)}
    if digits is not None:
        return {"mode": "QUANTUM", "quantum": Decimal(1).scaleb(-digits)}
    return {"mode": "EXACT"}


def matches(stated: Decimal, found: Decimal, precision: dict, both: bool = False) -> bool:
    """Exactly, after rounding the found value (and the stated one, if both) half to even to the quantum, or within the tolerance, bounds included."""
    with localcontext(Context(prec=100, rounding=ROUND_HALF_EVEN)):
        if precision["mode"] == "ABS_TOLERANCE":
            return abs(stated - found) <= precision["tolerance"]
        if precision["mode"] == "QUANTUM":
            q = precision["quantum"]
            step = lambda x: (x / q).to_integral_value() * q
            return (step(stated) if both else stated) == step(found)
        return stated == found


def compare(stated: Decimal, found: Decimal, precision: dict) -> str:
    if matches(stated, found, precision):
        return "signed_equivalent"
    return "opposite_sign_magnitude_only" if matches(abs(stated), abs(found), precision) else "different"


def stage1(targets: DataFrame, facts: DataFrame, passes: Column) -> DataFrame:
    """targets (target_id, company, chunk_ids, ...): facts linked to an approved chunk, of the same company, that pass the comparison."""
    t = targets.select("*", F.explode("chunk_ids").alias("chunk_id")).drop("chunk_ids")
    return t.join(facts, ["chunk_id", "company"]).filter(passes).withColumn("stage", F.lit(1))


def stage2(parents: DataFrame, facts: DataFrame, same: list[str]) -> DataFrame:
    """Facts of other accessions that agree with a passing parent in `same`."""
    p = parents.select("target_id", F.col("fact_id").alias("parent_id"), F.col("accession").alias("_a"), *same)
    return p.join(facts, same).filter(F.col("accession") != F.col("_a")).drop("_a").withColumn("stage", F.lit(2))


def stage3(targets: DataFrame, facts: DataFrame, seen: DataFrame, on: list[str], passes: Column) -> DataFrame:
    """The constrained search for targets with an exact time and no passing candidate: equal in `on`, not seen before."""
    open_ = targets.filter("exact_time").join(seen.filter("passed").select("target_id").distinct(), "target_id", "left_anti")
    return open_.join(facts, on).filter(passes).join(seen.select("target_id", "fact_id"), ["target_id", "fact_id"], "left_anti").withColumn("stage", F.lit(3))


def deduped(candidates: DataFrame) -> DataFrame:
    """The first of each target and fact by stage and parent, in total order."""
    w = Window.partitionBy("target_id", "fact_id").orderBy("stage", F.asc_nulls_first("parent_id"))
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy("target_id", "stage", "fact_id")


def statuses(targets: DataFrame, checks: DataFrame, searched: DataFrame) -> DataFrame:
    """checks (target_id, result), searched (target_id): any PASS maps; else any UNRESOLVED is unmappable; else a completed search finds no counterpart."""
    n = lambda v: F.count(F.when(F.col("result") == v, 1)).alias(v)
    c = checks.groupBy("target_id").agg(n("PASS"), n("UNRESOLVED"), n("REJECT"))
    out = targets.select("target_id").join(c, "target_id", "left").join(searched.select("target_id", F.lit(True).alias("_s")), "target_id", "left")
    status = F.when(F.col("PASS") > 0, "mapped").when(F.col("UNRESOLVED") > 0, "unmappable").when(F.col("_s"), "no_counterpart").otherwise("unmappable")
    return out.select("target_id", status.alias("status"))


def resolve_time(targets: DataFrame, contexts: DataFrame, table_periods: DataFrame) -> DataFrame:
    """Exact target dates, else the one period of linked contexts, else ambiguous, else the one period of tables, else unresolved."""
    one = lambda d, s: d.groupBy("target_id").agg(F.countDistinct("period").alias(f"n_{s}"), F.min("period").alias(f"p_{s}"))
    j = targets.join(one(contexts, "c"), "target_id", "left").join(one(table_periods, "t"), "target_id", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n_c") == 1, "unique_context").when(F.col("n_c") > 1, "ambiguous").when(F.col("n_t") == 1, "unique_table").when(F.col("n_t") > 1, "ambiguous").otherwise("unresolved")
    period = F.when(how == "exact", F.col("exact")).when(how == "unique_context", F.col("p_c")).when(how == "unique_table", F.col("p_t"))
    return j.select("target_id", how.alias("resolution"), period.alias("period"))


def column_periods(cells: DataFrame) -> DataFrame:
    """cells (table_id, col, period, linked_period): a column with several periods, several linked periods, or a linked one that contradicts is a conflict;
    agreeing ones merge; a period stated by the table alone is derived; else the column is skipped."""
    g = cells.groupBy("table_id", "col").agg(F.countDistinct("period").alias("n"), F.min("period").alias("p"), F.countDistinct("linked_period").alias("m"), F.min("linked_period").alias("q"))
    state = F.when(F.col("n") > 1, "conflict_column_period").when(F.col("m") > 1, "conflict_linked_period").when((F.col("n") == 1) & (F.col("m") == 1) & (F.col("p") != F.col("q")), "conflict_contradiction")
    state = state.when(F.col("m") == 1, "merged").when(F.col("n") == 1, "derived").otherwise("skipped")
    return g.select("table_id", "col", state.alias("state"), F.when(state.isin("merged", "derived"), F.coalesce("q", "p")).alias("period"))


def overlay(base: DataFrame, errata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """errata (key, field, old_value, new_value as strings): a correction applies to an allowed field whose old value is on record. Adds `errors`: fields not
    allowed, old values that differ, repeated corrections; those change nothing."""
    e = errata.groupBy(key, "field").agg(F.count("*").alias("n"), F.min("old_value").alias("old"), F.min("new_value").alias("new")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("n", "old", "new")))).alias("_e"))
    out, errors = base.join(e, key, "left"), []
    cols = []
    for c in base.columns:
        x = F.col("_e")[c]
        if c in fields:
            ok = (x["n"] == 1) & (x["old"] == F.col(c).cast("string"))
            cols.append(F.when(ok, x["new"].cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c))
            errors.append(F.when(x["n"] > 1, F.concat(F.lit("repeated:"), F.lit(c))).when(x.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.concat(F.lit("old_value:"), F.lit(c))))
        else:
            cols.append(F.col(c))
            errors.append(F.when(x.isNotNull(), F.concat(F.lit("not_allowed:"), F.lit(c))))
    return out.select(*cols, F.array_compact(F.array(*errors)).alias("errors"))


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every field that differs, null-safe, and of rows that only one side has (field `row`)."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    each = [F.when(both & ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old_value"), F.col(f"n.{f}").cast("string").alias("new_value"))) for f in fields]
    row = F.when(~both, F.struct(F.lit("row").alias("field"), F.when(F.col(f"o.{key}").isNotNull(), "present").otherwise("absent").alias("old_value"), F.when(F.col(f"n.{key}").isNotNull(), "present").otherwise("absent").alias("new_value")))
    out = j.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), F.explode(F.array_compact(F.array(*each, row))).alias("d"))
    return out.select(key, "d.*")


def assigned(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Eligible claims meet answer groups by position: the n-th of a question's claims is the n-th slot, a group holding `multiplicity` slots."""
    slots = groups.select("q_id", "group_id", F.explode(F.sequence(F.lit(1), F.col("multiplicity"))).alias("_m"))
    slots = slots.withColumn("slot", F.row_number().over(Window.partitionBy("q_id").orderBy("group_id", "_m"))).drop("_m")
    own = claims.withColumn("slot", F.row_number().over(Window.partitionBy("q_id").orderBy("position")))
    return slots.join(own, ["q_id", "slot"], "left")


def conjunction(*parts: Column) -> Column:
    """True if every part that applies is; null if none applies."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.forall(known, lambda x: x))


def micro(slots: DataFrame, by: list[str]) -> DataFrame:
    """Sums over applicable slots: failed runs stay in the denominator with nothing, infrastructure failures are listed and make the aggregate incomplete."""
    infra, fail = F.col("run_status").startswith("INFRA_"), F.col("run_status").startswith("FAIL_")
    num = F.sum(F.when(infra, None).when(fail, 0).otherwise(F.col("numerator")))
    den = F.sum(F.when(infra, None).otherwise(F.col("denominator")))
    return slots.groupBy(*by).agg(num.alias("numerator"), den.alias("denominator"), F.try_divide(num, den).alias("micro"), F.count(F.when(infra, 1)).alias("n_missing"), F.when(F.count(F.when(infra, 1)) > 0, "EVAL_INCOMPLETE").otherwise("EVAL_COMPLETE").alias("state"))


def paths_matched(paths: DataFrame, cited: DataFrame) -> DataFrame:
    """(claim_id, matched): paths (claim_id, path_id, member) match when all members are cited; one path is enough."""
    got = paths.join(cited.select("claim_id", "member").distinct().withColumn("_c", F.lit(1)), ["claim_id", "member"], "left")
    each = got.groupBy("claim_id", "path_id").agg((F.count("*") == F.count("_c")).alias("all_"))
    return each.groupBy("claim_id").agg(F.max("all_").alias("matched"))
