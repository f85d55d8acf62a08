"""Record layouts as trees: children, bytes and offsets of each field.

Edge cases: an item without a picture and without children has no bytes.  Tables count with their greatest number of
elements; the offset of what stands in one is that of its first element.  An item that redefines another begins where
that one does and adds nothing to its group; the group is as long as the longest of them.  Levels 66, 77 and 88 hold no place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

LAYOUTS = 256  # whose fields are Python values at a time
SCHEMA = "line int, level int, name string, parent string, children array<string>, offset int, element_bytes int, bytes int, occurs int, depends_on string, path string"


def elementary_bytes(picture: Column, usage: Column, length: Column | None = None) -> Column:
    """The bytes of an item: by its digits where it is binary or packed, by its characters else; a separate sign is not looked for."""
    size = F.coalesce(N.pic_length(picture) if length is None else length, F.lit(0))
    binary = F.when(size <= 4, 2).when(size <= 9, 4).otherwise(8)
    return (F.when(usage.isin("COMP", "COMP-4", "COMP-5", "BINARY"), binary).when(usage == "COMP-1", 4).when(usage == "COMP-2", 8).when(usage == "INDEX", 4)
            .when(usage.isin("COMP-3", "PACKED-DECIMAL"), F.floor(size / 2) + 1).otherwise(size)).cast("int")


def tree(items: DataFrame, key: str) -> DataFrame:
    """The fields of layouts with parents, children, offsets, lengths and paths (see SCHEMA); items as extract.data_items gives them.

    A layout is one source's items; a stack goes through them in order, so a task holds the fields of a few layouts at a time.
    """
    rows = items.where("level not in (66, 77, 88)").withColumn("_length", N.pic_length(F.col("picture"))).select(
        F.col(key).alias("key"), "line", "level", "name", F.coalesce(F.when(F.col("picture").isNotNull() | F.col("usage").isNotNull(), elementary_bytes(F.col("picture"), F.coalesce("usage", F.lit("DISPLAY")), F.col("_length"))), F.lit(0)).alias("own"),
        F.coalesce("occurs.max", F.lit(1)).alias("occurs"), F.col("occurs.depending_on").alias("depends_on"), "redefines")
    kind = rows.schema["key"].dataType.simpleString()
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def build(fields: list[dict]) -> list[dict]:
        stack: list[dict] = []
        done: list[dict] = []

        def close(level: int) -> None:
            while stack and stack[-1]["level"] >= level:
                f = stack.pop()
                f["element_bytes"] = max(f["end"], f["own"])
                f["bytes"] = f["element_bytes"] * f["occurs"]
                if stack:
                    above = stack[-1]
                    above["end"] = max(above["end"], f["at"] + f["bytes"])
                    above["next"] = above["next"] if f["redefines"] else f["at"] + f["bytes"]

        for f in fields:
            close(f["level"])
            above = stack[-1] if stack else None
            others = above["parts"] if above else {}
            at = others[f["redefines"]] if f["redefines"] in others else (above["next"] if above else 0)
            f |= {"at": at, "offset": at + (above["offset"] if above else 0), "next": 0, "end": 0, "parts": {}, "children": [], "parent": above and above["name"], "path": (above["path"] + "." if above else "") + f["name"]}
            if f["redefines"] not in others:
                f["redefines"] = None
            if above:
                above["children"].append(f["name"])
                others.setdefault(f["name"], at)
            stack.append(f)
            done.append(f)
        close(0)
        return done

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"children": pa.list_(pa.string()), **dict.fromkeys(("name", "parent", "depends_on", "path"), pa.string())}
        for batch in batches:
            for at in range(0, batch.num_rows, LAYOUTS):
                some = batch.slice(at, LAYOUTS)
                built = [build(fields) for fields in some.column(1).to_pylist()]
                of = pa.array([i for i, fields in enumerate(built) for _ in fields], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0).take(of)] + [pa.array([f[n] for fields in built for f in fields], types.get(n, pa.int32())) for n in names], ["key", *names])

    held = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c != "key")))).alias("fields"))
    return held.mapInArrow(trees, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
