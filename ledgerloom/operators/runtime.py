"""Tools behind one registry: validated arguments, exactly one call, errors as records, an append-only ledger."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.canonical import canonical_json, sha256
from . import calculator
from . import facts as catalog

#: Fixed value: the grammar of call ids.
CALL_ID = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}")
KINDS = {"string": str, "integer": int, "boolean": bool, "object": dict, "array": list}


class ToolError(ValueError):
    """A call that its tool refuses; kind names the reason."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Operation:
    tool: str
    name: str
    call: Callable
    arguments: dict
    version: str = "1"

    def spec(self) -> dict:
        return {"tool": self.tool, "operation": self.name, "version": self.version, "arguments": self.arguments}


def checked(arguments: dict, schema: dict) -> dict:
    """Arguments with declared defaults filled in; anything undeclared, missing, of another type or out of range is an error."""
    if extra := sorted(set(arguments) - set(schema)):
        raise ToolError("input", f"unknown arguments {extra}")
    out = {}
    for name, rule in schema.items():
        if name not in arguments:
            if rule.get("required"):
                raise ToolError("input", f"{name} is missing")
            if "default" in rule:
                out[name] = rule["default"]
            continue
        v = arguments[name]
        kind = KINDS[rule["type"]]
        if not isinstance(v, kind) or kind is int and isinstance(v, bool):
            raise ToolError("input", f"{name} isn't of type {rule['type']}")
        if "minimum" in rule and v < rule["minimum"] or "maximum" in rule and v > rule["maximum"]:
            raise ToolError("input", f"{name} is out of range")
        if "pattern" in rule and not re.fullmatch(rule["pattern"], v):
            raise ToolError("input", f"{name} doesn't match {rule['pattern']}")
        if "enum" in rule and v not in rule["enum"]:
            raise ToolError("input", f"{name} isn't one of {rule['enum']}")
        out[name] = v
    return out


@dataclass
class Registry:
    operations: dict = field(default_factory=dict)
    ledger: list = field(default_factory=list)

    def register(self, op: Operation) -> None:
        if (op.tool, op.name) in self.operations:
            raise ToolError("duplicate", f"{op.tool}.{op.name} is registered")
        self.operations[(op.tool, op.name)] = op

    def specs(self) -> list[dict]:
        return [self.operations[k].spec() for k in sorted(self.operations)]

    def resolve(self, tool: str, operation: str) -> Operation:
        if (tool, operation) in self.operations:
            return self.operations[(tool, operation)]
        raise ToolError("unknown_operation" if any(t == tool for t, _ in self.operations) else "unknown_tool", f"{tool}.{operation}")

    def invoke(self, call_id: str, tool: str, operation: str, arguments: dict) -> dict:
        """One call without retries; the envelope carries a result or an error and goes on the ledger with its hash."""
        if not CALL_ID.fullmatch(call_id):
            raise ToolError("input", "malformed call id")
        if any(r["call_id"] == call_id for r in self.ledger):
            raise ToolError("duplicate", f"call id {call_id} was used")
        envelope = {"call_id": call_id, "tool": tool, "operation": operation, "arguments": arguments, "status": "ok", "result": None, "error": None}
        try:
            op = self.resolve(tool, operation)
            envelope["arguments"] = checked(arguments, op.arguments)
            envelope["result"] = op.call(**envelope["arguments"])
        except Exception as e:  # whatever a tool raises becomes a record; the ledger has every call
            kind = getattr(e, "kind", None) or ("input" if isinstance(e, ValueError) else "tool_failure")
            envelope |= {"status": "error", "error": {"kind": kind, "type": type(e).__name__, "message": str(e).split("\n", 1)[0]}}
        try:
            canonical_json(envelope)
        except (TypeError, ValueError) as e:
            envelope |= {"arguments": repr(arguments), "status": "error", "result": None, "error": {"kind": "tool_failure", "type": type(e).__name__, "message": "not JSON"}}
        previous = self.ledger[-1]["hash"] if self.ledger else ""
        self.ledger.append(envelope | {"position": len(self.ledger), "hash": sha256(previous + canonical_json(envelope))})
        return envelope


def standard(spark: SparkSession, search: Callable[[str, int], list[dict]], facts: DataFrame, most: int = 1000) -> Registry:
    """The four operations: calculator.calculate, retrieval.search, xbrl.search and xbrl.query. search(query, top_k) gives rows best first; facts is a catalog as
    in `facts`. Results are plain JSON; a query of more than `most` facts is an error, not a cut."""
    r = Registry()
    text = {"type": "string", "required": True, "pattern": r"(?s).*\S.*"}
    top = {"type": "integer", "default": 10, "minimum": 1, "maximum": 50}

    def retrieval(query: str, top_k: int) -> list[dict]:
        got = search(query.strip(), top_k)
        if len(got) < top_k:
            raise ToolError("too_few_results", f"{len(got)} of {top_k} results")
        return got

    def concepts(query: str, top_k: int) -> list[dict]:
        return [x.asDict() for x in catalog.search(facts, query, top_k).orderBy("rank").collect()]

    def fact_query(concept: str, filters: dict, include_dimensions: bool) -> dict:
        found = catalog.query(facts, concept, **filters)
        rows = catalog.public(found, include_dimensions).orderBy("fact_id").limit(most + 1).collect()
        if len(rows) > most:
            raise ToolError("too_many_results", f"more than {most} facts; add filters")
        said = catalog.trace(facts, found, {"concept": concept, **filters}).first().asDict()
        return {"facts": [{k: v if v is None or isinstance(v, (str, int, bool, list)) else str(v) for k, v in x.asDict(recursive=True).items()} for x in rows], "trace": said}

    r.register(Operation("calculator", "calculate", lambda **a: calculator.calculate(**a), {"expression": text, "inputs": {"type": "object", "required": True}, "result_metadata": {"type": "object", "default": {}}}))
    r.register(Operation("retrieval", "search", retrieval, {"query": text, "top_k": top}))
    r.register(Operation("xbrl", "search", concepts, {"query": text, "top_k": top}))
    r.register(Operation("xbrl", "query", fact_query, {"concept": text, "filters": {"type": "object", "default": {}}, "include_dimensions": {"type": "boolean", "default": True}}))
    return r
