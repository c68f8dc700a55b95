"""Deeply nested semi-structured records as related flat tables.

Method: Merkle subtree identities. Every object is canonicalised and hashed
bottom-up, its identity covering its own fields and its children's identities in
order; identical objects are stored once, and bridge rows (parent, ordinal,
child) preserve every occurrence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pathwright.session import written


@dataclass(frozen=True)
class Level:
    """One level of nesting: its name, the fields that may hold its list (the first that has one counts), and the levels below."""

    name: str
    fields: tuple[str, ...]
    below: tuple["Level", ...] = field(default=())


#: A reasoning output: claims, their ingredients, and an ingredient's candidates and groundings; the second names are of older exports.
REASONING = Level(
    "output",
    (),
    (
        Level(
            "claim",
            ("rewritten_claims", "claims"),
            (
                Level(
                    "ingredient",
                    ("ingredients", "enabling_contributions"),
                    (Level("candidate", ("candidate_studies_considered",)), Level("grounding", ("additional_groundings",))),
                ),
            ),
        ),
    ),
)
#: Fields of which a JSON object needs one to be taken for a record.
RECORD_FIELDS = ("rewritten_claims", "claims", "original_discovery_claim", "claim_split_decision", "paper_level_notes")

_NODES = "level string, node_id binary, value string"
_BRIDGE = "level string, parent_id binary, ordinal int, child_id binary"


def decoded(value: object) -> object:
    """A list or object that is given as JSON text, however often quoted; anything else as it is."""
    while isinstance(value, str):  # each step makes the text shorter
        text = value.strip().lstrip("﻿")
        if text[:1] not in ("{", "[", '"') and text != "null":
            return value
        try:
            inner = json.loads(text, strict=False)
        except (ValueError, RecursionError):
            return value
        if isinstance(inner, (int, float, bool)):
            return value
        value = inner
    return value


def find_record(text: str | None, names: tuple[str, ...] = RECORD_FIELDS) -> dict | None:
    """The first JSON object with one of the fields (nested so deep that the parser gives up counts as broken) that stands in a text, whatever is around it: prose, fences, a byte order mark,
    quoting as a JSON string, or a list of one. None for NULL, empty, cut-off and broken JSON and for texts without a record."""
    if not text:
        return None

    def record(value: object) -> dict | None:
        value = decoded(value)
        if isinstance(value, list):
            return next((r for r in map(record, value) if r is not None), None)
        return value if isinstance(value, dict) and any(n in value for n in names) else None

    whole = text.strip().lstrip("﻿")
    try:
        return record(json.loads(whole, strict=False))
    except RecursionError:
        return None
    except ValueError:
        pass
    decoder = json.JSONDecoder(strict=False)
    at = 0
    while at < len(whole):
        starts = [i for i in (whole.find(c, at) for c in '{["') if i >= 0]
        if not starts:
            return None
        at = min(starts)
        try:
            value, end = decoder.raw_decode(whole, at)
        except ValueError:
            at += 1
            continue
        except RecursionError:
            return None
        found = record(value)
        if found is not None:
            return found
        at = end
    return None


def as_list(value: object) -> list:
    """The elements of a field: a list's; an object or plain text in place of a list is a list of one; NULL and blank text have none."""
    value = decoded(value)
    if value is None or isinstance(value, str) and not value.strip():
        return []
    return value if isinstance(value, list) else [value]


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces: equal for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _identity(level: str, value: str, children: list[tuple[str, int, bytes]]) -> bytes:
    h = xxhash.xxh3_128(level.encode() + b"\0" + value.encode("utf-8", "surrogatepass"))
    for name, ordinal, child in children:
        h.update(f"\1{name}\0{ordinal}\0".encode() + child)
    return h.digest()


def shredded(value: object, level: Level, nodes: dict, bridge: dict) -> bytes:
    """The identity of an object, after it and all below it are entered: nodes[identity] = (level, canonical own fields), and
    bridge[identity] = its (level, ordinal, child identity) rows. A NULL element gives no child but keeps its ordinal."""
    value = decoded(value)
    own: object = value
    children: list[tuple[str, int, bytes]] = []
    if isinstance(value, dict):
        own = dict(value)
        for lower in level.below:
            given = None
            for name in lower.fields:
                found = own.pop(name, None)
                if given is None and found is not None:
                    given = found
            for ordinal, element in enumerate(as_list(given)):
                if decoded(element) is not None:
                    children.append((lower.name, ordinal, shredded(element, lower, nodes, bridge)))
    text = canonical(own)
    node = _identity(level.name, text, children)
    nodes[node] = level.name, text
    bridge[node] = children
    return node


@dataclass(frozen=True)
class Shredded:
    """Related flat tables: roots (id, node_id) of the records, nodes (level, node_id, value) stored once, and
    bridge (level, parent_id, ordinal, child_id), level being the child's."""

    roots: DataFrame
    nodes: DataFrame
    bridge: DataFrame


def shred(records: DataFrame, id_column: str, payload: str, level: Level = REASONING, names: tuple[str, ...] = RECORD_FIELDS) -> Shredded:
    """Turns the JSON record in each row's payload into related flat tables.

    Repeated rows and identical objects are stored once. A payload that is NULL, empty, cut off, broken or no record gives no row in any
    table, and so does a NULL id; an empty table gives empty tables. Other columns are ignored."""
    rows = records.select(F.col(id_column).alias("_id"), F.col(payload).alias("_p")).where("_id is not null and _p is not null and _p <> ''")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                out: list[list] = [[], [], [], [], [], []]

                def put(*row) -> None:
                    for column, value in zip(out, row):
                        column.append(value)

                if len(seen) > 500_000:
                    seen.clear()
                for i, text in enumerate(part.column(1).to_pylist()):
                    record = find_record(text, names)
                    if record is None:
                        continue
                    nodes: dict = {}
                    bridge: dict = {}
                    put(i, level.name, None, None, shredded(record, level, nodes, bridge), None)
                    for node, (name, value) in nodes.items():
                        if node not in seen:
                            seen.add(node)
                            put(None, name, None, None, node, value)
                            for lower, ordinal, child in bridge[node]:
                                put(None, lower, node, ordinal, child, None)
                ids = part.column(0).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.string())],
                    names=["id", "level", "parent_id", "ordinal", "node_id", "value"],
                )

    flat = written(rows.mapInArrow(run, f"id {kind}, level string, parent_id binary, ordinal int, node_id binary, value string"))
    return Shredded(
        roots=flat.where("id is not null").select(F.col("id").alias(id_column), "node_id").distinct(),
        nodes=flat.where("value is not null").groupBy("level", "node_id").agg(F.min("value").alias("value")),
        bridge=flat.where("parent_id is not null").select("level", "parent_id", "ordinal", F.col("node_id").alias("child_id")).distinct(),
    )


def occurrences(tables: Shredded, id_column: str) -> DataFrame:
    """(id, level, claim_pos, ingredient_pos, child_pos, parent_id, node_id): every occurrence of every element of reasoning outputs,
    unfolded from the bridge. Positions count from 0 in the list as given; those below the level are -1."""
    bridge = tables.bridge

    def below(parents: DataFrame, level: str, position: str) -> DataFrame:
        b = bridge.where(F.col("level") == level).select(F.col("parent_id").alias("node_id"), F.col("ordinal").alias(position), F.col("child_id"))
        return parents.join(b, "node_id").withColumnRenamed("node_id", "parent_id").withColumnRenamed("child_id", "node_id")

    none = F.lit(-1)
    columns = [id_column, "level", "claim_pos", "ingredient_pos", "child_pos", "parent_id", "node_id"]
    claims = below(tables.roots.select(id_column, "node_id"), "claim", "claim_pos")
    ingredients = below(claims.select(id_column, "claim_pos", "node_id"), "ingredient", "ingredient_pos")
    parents = ingredients.select(id_column, "claim_pos", "ingredient_pos", "node_id")
    out = claims.withColumns({"level": F.lit("claim"), "ingredient_pos": none, "child_pos": none}).select(*columns)
    out = out.unionByName(ingredients.withColumns({"level": F.lit("ingredient"), "child_pos": none}).select(*columns))
    for level in ("candidate", "grounding"):
        out = out.unionByName(below(parents, level, "child_pos").withColumn("level", F.lit(level)).select(*columns))
    return out


def elements(outputs: DataFrame) -> DataFrame:
    """(output_id, level, claim_pos, ingredient_pos, child_pos) of every element of every reasoning output, distinct."""
    return occurrences(shred(outputs, "output_id", "payload"), "output_id").drop("parent_id", "node_id").distinct()


#: Columns of the flat tables and the fields they come from.
FIELDS = {
    "claim": {"claim_id": "claim_id", "artifact_type": "artifact_type", "rewritten_claim": "rewritten_claim", "why_this_is_atomic": "why_this_is_atomic", "decision": "decision", "cluster_id": "cluster_id"},
    "ingredient": {"ingredient_id": "ingredient_id", "ingredient": "ingredient", "role": "role", "necessary": "necessary", "from_prior_work": "from_prior_work", "maps_cleanly_to_one_study": "maps_cleanly_to_one_study", "evidence_span": "evidence_span", "canonical_ref_id": "canonical_grounding_decision.ref_id"},
    "candidate": {"study": "study", "decision": "decision", "why": "why"},
    "grounding": {"ref_id": "ref_id", "paper_id": "paper_id", "ref_title": "ref_title", "ref_year": "ref_year"},
}
#: The field that a plain text element stands for.
TEXT_FIELD = {"claim": "rewritten_claim", "ingredient": "ingredient", "candidate": "study", "grounding": "ref_title"}


def flat_table(tables: Shredded, level: str) -> DataFrame:
    """(node_id, columns of FIELDS[level]) of the distinct objects of a level, each field as text; an absent one is NULL.

    A plain text element fills TEXT_FIELD[level] alone."""
    n = tables.nodes.where(F.col("level") == level)
    plain = F.col("value").startswith('"')
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]
    columns = [F.when(plain, text if c == TEXT_FIELD[level] else F.lit(None).cast("string")).otherwise(F.get_json_object("value", f"$.{path}")).alias(c) for c, path in FIELDS[level].items()]
    return n.select("node_id", *columns)
