"""Table diff: multiset matching of equal rows, positional pairing of what is left, cell-level changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import KEY_TYPE, absent_key, csv_key, key_token, token_key, typed_key
from ..session import cut
from .numbering import all_of, number_rows, same

OLD, NEW = 0, 1


def _field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def column_status(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, str]]:
    """Columns of the new side in order, then those only the old side has, each with its status."""
    old_set, new_set = set(old), set(new)
    out = [(c, "present" if c in old_set else "added") for c in new]
    return out + [(c, "removed") for c in old if c not in new_set]


def unify_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    status = column_status(old.columns, new.columns)
    rows = [(i, name, tag) for i, (name, tag) in enumerate(status)]
    return new.sparkSession.createDataFrame(rows, "position int, column string, status string")


def cell_keys(df: DataFrame, columns: Sequence[str], typing: str = "typed") -> list[Column]:
    """Canonical key per column; a column the table lacks gets the absent key."""
    types = _field_types(df)
    keyed = []
    for c in columns:
        if c not in types:
            keyed.append(absent_key())
        elif typing == "csv":
            keyed.append(csv_key(F.col(c)))
        elif typing == "token":
            keyed.append(token_key(F.col(c)))
        else:
            keyed.append(typed_key(F.col(c), types[c]))
    return keyed


def project_onto(df: DataFrame, columns: Sequence[str], typing: str = "typed") -> DataFrame:
    """Cells of the given columns as (display, key) structs; a missing column has the absent key, not NULL."""
    types = _field_types(df)
    cells = []
    for c, key in zip(columns, cell_keys(df, columns, typing)):
        display = F.col(c).cast("string") if c in types else F.lit(None).cast("string")
        cells.append(F.struct(display.alias("display"), key.alias("key")).alias(c))
    return df.select(*cells)


def _comparable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.StructType, T.ArrayType, T.VariantType, T.FloatType, T.DoubleType))


def _key_columns(old: DataFrame, new: DataFrame, columns: Sequence[str], typing: str) -> tuple[list[Column], list[Column]]:
    """Row-key parts per side: the value itself where both sides store one type, else its canonical key."""
    old_types, new_types = _field_types(old), _field_types(new)
    canonical_old, canonical_new = cell_keys(old, columns, typing), cell_keys(new, columns, typing)
    left, right = [], []
    for i, c in enumerate(columns):
        a, b = old_types.get(c), new_types.get(c)
        if typing == "typed" and a is not None and a == b and _comparable(a):
            left.append(F.col(c)), right.append(F.col(c))
        elif typing == "typed" and a is not None and a == b and isinstance(a, (T.FloatType, T.DoubleType)):
            plain = F.col(c) + F.lit(0.0).cast(a)  # one zero
            left.append(plain), right.append(plain)
        else:
            left.append(canonical_old[i]), right.append(canonical_new[i])
    if any(is_wide(df, k) for df, side in ((old, left), (new, right)) for k in side):
        return [row_digest(old, left)], [row_digest(new, right)]
    return left, right


# fixed values: types short enough to be a key as they are; a key with any other column travels as a digest
NARROW = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def is_wide(df: DataFrame, key: Column) -> bool:
    """Whether values of the key's type may be long."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    return not isinstance(kind, T.DecimalType) and kind.simpleString() not in NARROW


def row_digest(df: DataFrame, keys: Sequence[Column]) -> Column:
    """SHA-256 over the key parts, each with its length before it, so that distinct rows have distinct digests."""
    def text(key: Column) -> Column:
        kind = df.select(key.alias("k")).schema["k"].dataType
        if kind == KEY_TYPE:
            return key_token(key)
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(key).cast("string")
        if isinstance(kind, T.BinaryType):
            return F.hex(key)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (key + F.lit(0.0).cast(kind)).cast("string")  # one zero
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(key)
        return key.cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in map(text, keys)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


class TableDiff:
    """One diff. ``rows`` holds kind, positions and the two row structs; the rest is derived from it on demand."""

    def __init__(self, rows: DataFrame, columns: list[tuple[str, str]], by: Sequence[str], typing: str):
        self.rows = rows
        self.columns = columns
        self.by = list(by)
        self.typing = typing

    def _cell(self, side: str, name: str) -> tuple[Column, Column]:
        types = {f.name: f.dataType for f in self.rows.schema[side].dataType.fields}
        if name not in types:
            return F.lit(None).cast("string"), absent_key()
        value = F.col(side)[name]
        key = {"csv": lambda: csv_key(value), "token": lambda: token_key(value)}.get(
            self.typing, lambda: typed_key(value, types[name]))()
        return (F.when(F.col(side).isNotNull(), value.cast("string")),
                F.when(F.col(side).isNull(), absent_key()).otherwise(key))

    def cells(self) -> DataFrame:
        """One row per (row, column): old and new display, old and new key, and whether the keys differ.

        An unchanged row shows the new side's writing on both sides.
        """
        unchanged = F.col("kind") == "unchanged"
        parts = []
        for name, _ in self.columns:
            old, old_key = self._cell("old", name)
            new, new_key = self._cell("new", name)
            parts.append(F.struct(
                F.lit(name).alias("column"), F.when(unchanged, new).otherwise(old).alias("old"), new.alias("new"),
                F.when(unchanged, new_key).otherwise(old_key).alias("old_key"), new_key.alias("new_key")))
        spread = self.rows.select(*self.by, "kind", "old_pos", "new_pos", F.explode(F.array(*parts)).alias("cell"))
        differs = ~same(F.col("cell.old_key"), F.col("cell.new_key"))
        return spread.select(*self.by, "kind", "old_pos", "new_pos", "cell.*", differs.alias("changed"))

    def summary(self) -> DataFrame:
        return self.rows.groupBy(*self.by, "kind").agg(F.count(F.lit(1)).alias("n_rows"))

    def column_summary(self) -> DataFrame:
        """Changed cells per column; unchanged rows have none and are not expanded."""
        moved = TableDiff(self.rows.filter("kind <> 'unchanged'"), self.columns, self.by, self.typing)
        return moved.cells().filter("changed").groupBy(*self.by, "column").agg(
            F.count(F.lit(1)).alias("changed_cells"))

    def has_real_change(self) -> DataFrame:
        reshaped = any(tag != "present" for _, tag in self.columns)
        flag = F.coalesce(F.bool_or(F.col("kind") != "unchanged"), F.lit(False)) | F.lit(reshaped)
        return self.rows.groupBy(*self.by).agg(flag.alias("real_change")) if self.by else self.rows.agg(
            flag.alias("real_change"))


def diff_tables(old: DataFrame, new: DataFrame, order_old: str, order_new: str, by: Sequence[str] = (),
                typing: str = "typed") -> TableDiff:
    """Diff two tables whose row order is given by one position column per side.

    Equal rows match one for one whatever their position; the i-th row left over on the old side pairs with the
    i-th on the new side and is ``modified`` where the two share a column, else a removal and an addition. ``by``
    diffs many tables in one job.

    Positions must order the rows of a table without ties. Rows meet on their values, or on a digest of them where a value may be
    long. Keys are counted first. Only a key that both sides hold a different number of times needs its copies
    numbered, so repeated rows cost one count, not one ordered group.
    """
    side_columns = lambda df, order: [c for c in df.columns if c != order and c not in by]
    old_cols, new_cols = side_columns(old, order_old), side_columns(new, order_new)
    columns = column_status(old_cols, new_cols)
    names = [c for c, _ in columns]
    shared = any(tag == "present" for _, tag in columns)
    reshaped = any(tag != "present" for _, tag in columns)
    old_keys, new_keys = _key_columns(old, new, names, typing)

    def side(df, order, keys, cols, tag):
        key_cols = [] if reshaped else [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        row = F.struct(*[F.col(c) for c in cols]).alias("old" if tag == OLD else "new")
        place = F.col(order).cast("long") if isinstance(df.schema[order].dataType, T.IntegralType) else F.col(order)
        return df.select(*by, F.lit(tag).alias("_side"), place.alias("_pos"), *key_cols, row)

    left_side, right_side = side(old, order_old, old_keys, old_cols, OLD), side(new, order_new, new_keys, new_cols, NEW)
    rows = left_side.unionByName(right_side, allowMissingColumns=True)
    keep = [*by, "_side", "_pos", "old", "new"]
    if reshaped:  # a column on one side only is absent on the other: no two rows are equal
        residual, unchanged = rows.select(*keep), None
    else:
        keys = [*by, *[f"_k{i}" for i in range(len(old_keys))]]
        counts = rows.groupBy(*keys).agg(F.count_if(F.col("_side") == OLD).alias("_n_old"),
                                         F.count_if(F.col("_side") == NEW).alias("_n_new"))
        uneven = cut(counts.filter("_n_old <> _n_new").select(
            *[F.col(k).alias(f"_u{i}") for i, k in enumerate(keys)], F.least("_n_old", "_n_new").alias("_keep")))
        match = all_of([same(F.col(k), F.col(f"_u{i}")) for i, k in enumerate(keys)])
        settled = right_side.join(uneven, match, "left_anti").select(*by, "_side", "_pos", "new")
        # few rows as a rule; written out because range partitioning reads its input twice
        open_rows = cut(rows.join(uneven, match).drop(*[f"_u{i}" for i in range(len(keys))]))
        if uneven.filter("_keep > 0").isEmpty():  # the usual case: no row is on both sides in different numbers
            residual, unchanged = open_rows.select(*keep), settled
        else:
            partial = number_rows(open_rows.filter("_keep > 0"), ["_pos"], by=[*keys, "_side"], name="_k")
            residual = open_rows.filter("_keep = 0").select(*keep).unionByName(
                partial.filter("_k > _keep").select(*keep))
            unchanged = settled.unionByName(
                partial.filter((F.col("_k") <= F.col("_keep")) & (F.col("_side") == NEW)).select(
                    *by, "_side", "_pos", "new"))

    numbered = number_rows(residual, ["_pos"], by=[*by, "_side"], name="_i")
    left = numbered.filter(F.col("_side") == OLD).select(*by, "_i", F.col("_pos").alias("old_pos"), "old")
    right = numbered.filter(F.col("_side") == NEW).select(*by, "_i", F.col("_pos").alias("new_pos"), "new")
    out = [*by, "kind", "old_pos", "new_pos", "old", "new"]
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    if shared:
        other = right.withColumnsRenamed({c: f"_n_{c}" for c in [*by, "_i"]})
        beside = all_of([same(F.col(c), F.col(f"_n_{c}")) for c in by]) & (F.col("_i") == F.col("_n__i"))
        paired = left.join(other, beside, "full").withColumns({
            "kind": F.when(F.col("_i").isNull(), "added").when(F.col("_n__i").isNull(), "removed").otherwise("modified"),
            **{c: F.coalesce(c, f"_n_{c}") for c in by}}).select(*out)
    else:
        paired = left.select(*by, F.lit("removed").alias("kind"), "old_pos", nothing(right, "new_pos"), "old",
                             nothing(right, "new")).unionByName(
            right.select(*by, F.lit("added").alias("kind"), nothing(left, "old_pos"), "new_pos",
                         nothing(left, "old"), "new"))
    if unchanged is not None:
        paired = paired.unionByName(unchanged.select(
            *by, F.lit("unchanged").alias("kind"), nothing(left, "old_pos"), F.col("_pos").alias("new_pos"),
            nothing(left, "old"), "new"))
    return TableDiff(paired, columns, by, typing)


def diff_counts(old: DataFrame, new: DataFrame, by: Sequence[str] = (), typing: str = "typed") -> DataFrame:
    """Counts per kind in one aggregation over (old, new): no row order, numbering or pairing is needed for them."""
    old_cols, new_cols = ([c for c in df.columns if c not in by] for df in (old, new))
    columns = column_status(old_cols, new_cols)
    names = [c for c, _ in columns]
    shared = any(tag == "present" for _, tag in columns)
    old_keys, new_keys = _key_columns(old, new, names, typing)
    keyed = lambda df, keys, tag: df.select(*by, F.lit(tag).alias("_side"),
                                            *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    rows = keyed(old, old_keys, OLD).unionByName(keyed(new, new_keys, NEW)) if all(
        tag == "present" for _, tag in columns) else keyed(old, [], OLD).unionByName(keyed(new, [], NEW))
    equal = F.least("_o", "_n") if all(tag == "present" for _, tag in columns) else F.lit(0).cast("long")
    per_key = rows.groupBy(*by, *[c for c in rows.columns if c.startswith("_k")]).agg(
        F.count_if(F.col("_side") == OLD).alias("_o"), F.count_if(F.col("_side") == NEW).alias("_n"))
    totals = per_key.groupBy(*by).agg(F.sum(equal).alias("_u"), F.sum("_o").alias("_ot"), F.sum("_n").alias("_nt"))
    left, right = F.col("_ot") - F.col("_u"), F.col("_nt") - F.col("_u")
    both = F.least(left, right) if shared else F.lit(0).cast("long")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n_rows")) for k, n in (
        ("unchanged", F.col("_u")), ("modified", both), ("added", right - both), ("removed", left - both))])
    return totals.select(*by, F.explode(kinds).alias("x")).select(*by, "x.*").filter("n_rows > 0")


def diff_test_data(old: DataFrame, new: DataFrame, test: str, ordinal: str, order: str) -> TableDiff:
    """Diff every given and expected table of every test in one job; tables are told apart by (test, ordinal)."""
    return diff_tables(old, new, order, order, by=[test, ordinal])


def changed_tables(diff: TableDiff) -> DataFrame:
    return diff.has_real_change().filter("real_change").select(*diff.by)


def diff_seeds(old: DataFrame, new: DataFrame, order: str, edges: DataFrame, seed: str) -> tuple[TableDiff, DataFrame]:
    """The diff of a seed table and the models that read it directly."""
    consumers = edges.filter(F.col("src") == seed).select(F.col("dst").alias("consumer")).distinct()
    return diff_tables(old, new, order, order), consumers
