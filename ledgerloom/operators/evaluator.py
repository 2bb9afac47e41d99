"""Deterministic evaluation of claims: whether what they cite exists, and whether derived values follow from approved inputs by an approved formula."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calculator, constraints, mapping

IDENTITY = ("accession", "concept", "context_ref", "unit", "instant", "period_start", "period_end")


def findings(cited: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """cited (owner_id, record_index, kind `chunk` or `xbrl_fact`, chunk_id, locator, fact_locator and IDENTITY), chunks (chunk_id, accession, locator, allowed), facts
    (fact_locator, chunk_id, IDENTITY, value): each citation with sorted reason codes, identity_valid, and hallucinated (what it names doesn't exist, or is of
    another filing). A fact that isn't numeric is no valid citation."""
    c = chunks.select(F.col("chunk_id").alias("_c"), F.struct("accession", "locator", "allowed").alias("c"))
    f = facts.select(F.col("fact_locator").alias("_f"), F.struct("chunk_id", "value", *IDENTITY).alias("f"))
    j = cited.join(c, (F.col("kind") == "chunk") & (F.col("chunk_id") == F.col("_c")), "left").join(f, (F.col("kind") == "xbrl_fact") & (F.col("fact_locator") == F.col("_f")), "left")
    chunk, no_c, no_f = F.col("kind") == "chunk", F.col("_c").isNull(), F.col("_f").isNull()
    other = F.lit(False)
    for k in IDENTITY:
        other = other | ~F.col(k).eqNullSafe(F.col(f"f.{k}"))
    say = lambda test, name: F.when(test, F.lit(name))
    reasons = F.array_sort(F.array_compact(F.array(
        say(chunk & no_c, "nonexistent_chunk_id"), say(chunk & ~no_c & ~F.col("accession").eqNullSafe(F.col("c.accession")), "wrong_accession"),
        say(chunk & ~no_c & ~F.col("locator").eqNullSafe(F.col("c.locator")), "metadata_inconsistent"), say(chunk & ~no_c & ~F.coalesce("c.allowed", F.lit(False)), "outside_source_contract"),
        say(~chunk & no_f, "nonexistent_fact_locator"), say(~chunk & ~no_f & other, "wrong_fact_identity"), say(~chunk & ~no_f & F.col("chunk_id").isNotNull() & ~F.col("chunk_id").eqNullSafe(F.col("f.chunk_id")), "wrong_chunk_linkage"),
        say(~chunk & ~no_f & (F.col("f.value").isNull() | F.col("f.unit").isNull()), "nonnumeric_fact"),
    )))
    lie = (chunk & no_c) | (~chunk & no_f) | (F.col("accession") != F.when(chunk, F.col("c.accession")).otherwise(F.col("f.accession")))
    return j.select("owner_id", "record_index", "kind", reasons.alias("reason_codes"), (F.size(reasons) == 0).alias("identity_valid"), F.coalesce(lie, F.lit(False)).alias("hallucinated"))


def numeric_match(value: str, unit: str, target: dict) -> bool:
    """A value in its unit against a target (value, unit, precision): units must be the same or registered equivalents; both sides are rounded to a quantum."""
    how = mapping.compare_units(unit, target["unit"])
    if how not in ("exact_label_match", "registered_equivalence"):
        return False
    try:
        a, b = Decimal(value), Decimal(target["value"])
        if how == "registered_equivalence":
            a, b = mapping.in_base(value, unit), mapping.in_base(target["value"], target["unit"])
        return mapping.matches(b, a, target["precision"], both=True)
    except (InvalidOperation, KeyError):
        return False


def order_of(calculations: dict[str, dict]) -> tuple[list[str], set[str]]:
    """Calculations with what they take from first, and those on or behind a cycle, or behind one that doesn't exist."""
    prior = {k: {i["calculation"] for i in c["inputs"] if i.get("calculation") is not None} for k, c in calculations.items()}
    done: list[str] = []
    ready = set()
    while fresh := sorted(k for k, p in prior.items() if k not in ready and p <= ready):
        done += fresh
        ready |= set(fresh)
    return done, set(prior) - ready


def arithmetic_ok(calc: dict) -> bool:
    try:
        return Decimal(calculator.evaluate(calc["expression"], {i["input_id"]: i["value"] for i in calc["inputs"]})) == Decimal(calc["result"]["value"])
    except (calculator.CalculatorError, InvalidOperation):
        return False


def derived(calculations: dict[str, dict], specs: dict[str, list[dict]], targets: dict[str, dict], cited: Callable[[str, str, str], bool]) -> dict[tuple[str, str], dict]:
    """{(calculation, target): result} of every calculation for every target that it may stand for.

    calculations: id -> {expression, inputs [{input_id, name, value, unit, calculation or null, fact (bool)}], result {value, unit}}; specs: target -> ways to derive it,
    each {inputs [{role, target}], formulas, unit, precision}; a target without a way is direct: a calculation may only hand on one input unchanged. cited(calculation,
    input_id, target) says whether the input's citations take an approved path to the target. Inputs are bound by role names if any has one, else in order. What a
    calculation takes from another must be that one's result, which must hold for the same target. Each result: input_results, formula, arithmetic, path,
    precision, complete. Calculations are worked off in order of their dependence, so depth needs no recursion; those behind a cycle hold for nothing."""
    order, broken = order_of(calculations)
    out: dict[tuple[str, str], dict] = {}
    for k in [*order, *sorted(broken)]:
        for t in targets:
            ways = [_one(k, spec, calculations, targets, cited, out, k in broken) for spec in specs.get(t, [])] or [_handed_on(k, t, calculations, targets, cited, out, k in broken)]
            out[(k, t)] = next((w for w in ways if w["complete"]), ways[0])
    return out


def _input_holds(k: str, item: dict, target: str, calculations: dict, targets: dict, cited, done: dict) -> tuple[bool, bool]:
    """(numeric, path) of one input for a target."""
    number = numeric_match(item["value"], item["unit"], targets[target])
    prior = item.get("calculation")
    if prior is None:
        return number, bool(item.get("fact")) and cited(k, item["input_id"], target)
    if (prior, target) not in done:
        return False, False
    from_it = calculations[prior]["result"]
    try:
        same = Decimal(item["value"]) == Decimal(from_it["value"]) and item["unit"] == from_it["unit"]
    except InvalidOperation:
        same = False
    return number and same and done[(prior, target)]["complete"], done[(prior, target)]["path"]


def _one(k: str, spec: dict, calculations: dict, targets: dict, cited, done: dict, broken: bool) -> dict:
    calc, roles = calculations[k], spec["inputs"]
    items, wanted = calc["inputs"], [r["role"] for r in roles]
    said = [i["name"] for i in items]
    if any(n in wanted for n in said):
        bound = {i["name"]: i for i in items if said.count(i["name"]) == 1 and i["name"] in wanted}
        binding = sorted(said) == sorted(wanted)
    else:
        bound, binding = dict(zip(wanted, items)), len(items) == len(wanted)
    results = []
    for r in roles:
        number, path = _input_holds(k, bound[r["role"]], r["target"], calculations, targets, cited, done) if r["role"] in bound else (False, False)
        results.append({"role": r["role"], "target": r["target"], "numeric": number and binding, "path": path})
    rename = {i["input_id"]: n for n, i in bound.items()}
    try:
        formula = binding and any(calculator.same_formula(f, calc["expression"], rename) for f in spec["formulas"])
    except calculator.CalculatorError:
        formula = False
    arithmetic = not broken and arithmetic_ok(calc) and calc["result"]["unit"] == spec["unit"]
    precision = numeric_match(calc["result"]["value"], calc["result"]["unit"], {"value": spec["value"], "unit": spec["unit"], "precision": spec["precision"]})
    path = not broken and all(x["path"] for x in results)
    return {"input_results": results, "formula": formula, "arithmetic": arithmetic, "path": path, "precision": precision, "complete": bool(results) and formula and arithmetic and path and precision and all(x["numeric"] for x in results)}


def _handed_on(k: str, target: str, calculations: dict, targets: dict, cited, done: dict, broken: bool) -> dict:
    calc = calculations[k]
    none = {"input_results": [], "formula": False, "arithmetic": False, "path": False, "precision": False, "complete": False}
    if broken or len(calc["inputs"]) != 1:
        return none
    item = calc["inputs"][0]
    number, path = _input_holds(k, item, target, calculations, targets, cited, done)
    same = calculator.parse(calc["expression"]) == calculator.Node("name", item["input_id"]) if calc["expression"].strip() == item["input_id"] else False
    arithmetic = arithmetic_ok(calc) and calc["result"]["unit"] == targets[target]["unit"]
    return {"input_results": [{"role": item["name"], "target": target, "numeric": number, "path": path}], "formula": same, "arithmetic": arithmetic, "path": path, "precision": number, "complete": same and number and path and arithmetic}


def index_report(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """What must hold of a frozen index of facts: unique locators; a context has one period, a filing one company, a locator one unit; facts' chunks exist; an instant
    excludes a period, and no period ends before it starts."""
    period = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("instant", "period_start", "period_end")])
    f = facts.withColumn("_period", period)
    instant, span = F.col("instant").isNotNull(), F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    timed = (instant & F.col("period_start").isNull() & F.col("period_end").isNull()) | (~instant & span & (F.col("period_end") >= F.col("period_start")))
    return constraints.together(
        constraints.unique(facts, ["fact_locator"], "a locator is one fact"), constraints.determines(f, ["accession", "context_ref"], "_period", "a context has one period"),
        constraints.determines(facts, ["accession"], "company", "a filing has one company"), constraints.refers(facts, "chunk_id", chunks, "chunk_id", "a fact's chunk exists"), constraints.holds(facts, ["fact_locator"], timed, "an instant or a period"),
    )


def gold_report(targets: DataFrame, members: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """targets (target_id, group_id, value), members (target_id, path_id, chunk_id, fact_locator): targets are unique and have a value, every target has a path, and what
    paths name exists."""
    pathless = targets.join(members.select("target_id").distinct(), "target_id", "left_anti")
    return constraints.together(
        constraints.unique(targets, ["target_id"], "a target occurs once"), constraints.holds(targets, ["target_id"], F.col("value").cast("decimal(38,10)").isNotNull(), "a target has a value"),
        constraints.holds(pathless, ["target_id"], F.lit(False), "a target has a path"), constraints.refers(members, "chunk_id", chunks, "chunk_id", "a path's chunk exists"),
        constraints.refers(members, "fact_locator", facts, "fact_locator", "a path's fact exists"),
    )


def self_consistent(gold: list[dict]) -> list[dict]:
    """Gold items (id, formula, inputs {name: value}, value, precision) recomputed by themselves before any scoring: those whose stated value isn't the formula's."""
    out = []
    for g in gold:
        try:
            found = calculator.evaluate(g["formula"], g["inputs"])
            ok = mapping.matches(Decimal(g["value"]), Decimal(found), g["precision"], both=True)
        except (calculator.CalculatorError, InvalidOperation) as e:
            found, ok = f"{type(e).__name__}: {e}", False
        if not ok:
            out.append({"id": g["id"], "stated": g["value"], "found": found})
    return out
