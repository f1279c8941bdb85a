"""Attribute-value rows into one typed row per entity."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import blank, clean_name, usable
from veldt.session import col, cut, hint

#: A catalogue becomes columns of one table; more attributes than this are refused.
MOST_ATTRIBUTES = 2000


def resolve_attribute(name: Column, attributes: list[str]) -> tuple[Column, Column]:
    """The longest attribute that equals the clean name or begins it followed by _, and the rest of the name."""
    if not attributes:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    longest = sorted(attributes, key=lambda a: (-len(a), a))
    pattern = r"^(" + "|".join(r"\Q" + a + r"\E" for a in longest) + r")(?:_(.*))?$"
    hit = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return hit, F.regexp_extract(name, pattern, 2)


def cells(rows: DataFrame, catalogue: list[tuple[str, str]], entity: str, name: str, value: str, at: str) -> DataFrame:
    """entity, attribute, text, num: the cell of each entity and attribute, that of the latest row.

    The latest row is taken by a combining aggregate, so an entity with very many rows sends at most one row per
    attribute and task. Of rows with the same time the larger cell holds.
    """
    kinds = dict(catalogue)
    category = [a for a, k in kinds.items() if k == "category"]
    base = rows.select(col(entity).cast("string").alias("entity"), col(name).alias("name"), col(value).cast("double").alias("v"), col(at).alias("at")).filter(~blank(F.col("entity")))
    resolve = lambda c: [c.alias("clean"), *[x.alias(n) for x, n in zip(resolve_attribute(c, list(kinds)), ("attribute", "rest"))]]
    # Names are few: each is cleaned and matched once, and the catalogue's ones are joined back.
    names = rows.select(col(name).cast("string").alias("name")).filter("name is not null").distinct().select("name", clean_name(F.col("name")).alias("cleaned"))
    names = cut(names).select("name", *resolve(F.col("cleaned"))).filter("attribute is not null")
    base = base.join(hint(cut(names)), "name").drop("name")
    is_cat = F.col("attribute").isin(category) if category else F.lit(False)
    text = F.when(is_cat & (F.col("v") == 1.0) & (F.col("rest") != ""), F.col("rest"))
    num = F.when(~is_cat & (F.col("clean") == F.col("attribute")) & usable(F.col("v")), F.col("v"))
    base = base.select("entity", "attribute", "at", text.alias("text"), num.alias("num")).filter("text is not null or num is not null")
    best = F.max(F.struct(F.coalesce(F.col("at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), "text", "num"))
    return base.groupBy("entity", "attribute").agg(best.alias("b")).select("entity", "attribute", "b.text", "b.num")


def _scatter(names: list[str], kinds: list[str], entity: str):
    """Arrow batches of (entity, attribute, text, num) of whole buckets into one typed row per entity."""
    column = {a: i for i, a in enumerate(names)}
    schema = pa.schema([(entity, pa.string()), *[(a, pa.string() if k == "category" else pa.int64()) for a, k in zip(names, kinds)]])

    def emit(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        ent = t["entity"].combine_chunks().dictionary_encode()
        att = t["attribute"].combine_chunks().dictionary_encode()
        r = ent.indices.to_numpy()
        c = np.array([column[a] for a in att.dictionary.to_pylist()], int)[att.indices.to_numpy()]
        n = len(ent.dictionary)
        txt, num = np.asarray(t["text"].to_numpy(zero_copy_only=False), object), t["num"].to_numpy(zero_copy_only=False).astype(float)
        cat = [i for i, k in enumerate(kinds) if k == "category"]
        slot = {i: j for j, i in enumerate(cat)}
        other = {i: j for j, i in enumerate(i for i in range(len(kinds)) if i not in slot)}
        texts = np.full((n, len(cat)), None, object)
        nums, there = np.zeros((n, len(other)), np.int64), np.zeros((n, len(other)), bool)
        is_cat = np.isin(c, cat)
        texts[r[is_cat], [slot[i] for i in c[is_cat]]] = txt[is_cat]
        at = r[~is_cat], np.array([other[i] for i in c[~is_cat]], int)
        v = np.rint(num[~is_cat])
        fits = np.abs(v) < 2.0**63
        nums[at] = np.where(fits, v, 0).astype(np.int64)
        there[at] = fits
        cols = [ent.dictionary.cast(pa.string())]
        for i, k in enumerate(kinds):
            cols.append(pa.array(texts[:, slot[i]], pa.string()) if k == "category" else pa.array(nums[:, other[i]], mask=~there[:, other[i]]))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches):
        # Rows come sorted by entity: a batch is emitted up to its last entity, whose rows may go on.
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 50_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            e = t["entity"]
            last, k = e[-1].as_py(), t.num_rows
            while k and e[k - 1].as_py() == last:
                k -= 1
            if k:
                yield emit(t.slice(0, k).to_batches())
            held = t.slice(k).combine_chunks().to_batches()
            rows = t.num_rows - k
        if held:
            yield emit(held)

    return run


def to_wide(rows: DataFrame, catalogue: DataFrame, entity: str = "user_id", name: str = "feature_name", value: str = "value", at: str = "loaded_at") -> DataFrame:
    """One row per entity that has a cell, with one column per catalogue attribute: text for categories, bigint for numbers.

    Feature names are cleaned and belong to the longest attribute that equals or begins them. Blank entities, unknown
    names, null values, NaN and infinities give no cell; a number is rounded to the nearest whole one (halves to the even
    one), and one beyond 64 bits is null; a null time is the earliest. Repeated rows change nothing. An empty table gives no row, an empty catalogue the
    entity column without rows. Other columns are ignored. The catalogue is counted: more than MOST_ATTRIBUTES raise.
    """
    kinds = [(r[0], r[1]) for r in catalogue.select("attribute", "kind").dropna().distinct().orderBy("attribute").limit(MOST_ATTRIBUTES + 1).collect()]
    if len(kinds) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    names, types = [a for a, _ in kinds], [k for _, k in kinds]
    ddl = ", ".join([f"`{entity}` string", *[f"`{a}` {'string' if k == 'category' else 'bigint'}" for a, k in kinds]])
    found = cells(rows, kinds, entity, name, value, at)
    bucketed = found.repartition("entity").sortWithinPartitions("entity")
    return bucketed.mapInArrow(_scatter(names, types, entity), ddl)


def to_long(wide: DataFrame, entity: str = "user_id") -> DataFrame:
    """The non-null cells of a wide table: entity, attribute, value_text."""
    names = [c for c in wide.columns if c != entity]
    if not names:
        return wide.select(entity, F.lit("").alias("attribute"), F.lit("").alias("value_text")).limit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), col(c).cast("string").alias("value_text")) for c in names]))
    return wide.select(col(entity), pairs.alias("p")).select(entity, "p.attribute", "p.value_text").filter("value_text is not null")
