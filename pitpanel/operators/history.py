"""Point-in-time history: aggregates of an entity's strictly earlier records.

Sources and targets are stacked and read through a range frame that ends one
period before the target's own: records of the same period never see each other.
All three blocks (any side, same side, opposite side) come from sums of one window
over the entity, so its rows are shuffled and sorted once; a window over a growing
range frame is one pass, not a join of every pair. Entities that hold more rows than a task
should are summed by period first and scanned in two levels (``scan``); the
values are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SIDES, flip, known_side, sample_std
from . import scan

ANY = [f"prev_ab_YearMonthIndex_{s}" for s in ("mean", "sum", "std")] + [f"prev_ab_all_label_{s}" for s in ("mean", "sum", "std")]
SAME = [f"prev_YearMonthIndex_{s}" for s in ("mean", "sum", "std")] + [f"prev_all_label_{s}" for s in ("mean", "sum", "std")]
OTHER = ["other_test_Test_id_count", "other_test_YearMonthIndex_mean", "other_test_YearMonthIndex_std", "other_test_Label_mean"]
FEATURES = ANY + SAME + OTHER


def fold_history(
    targets: DataFrame, sources: DataFrame, keys: Sequence[str] = (), blocks: Sequence[str] = ("any", "same", "other"), sides: Sequence[str] = SIDES, hot: Sequence | None = None, centre: int = 24000
) -> DataFrame:
    """``targets`` with the history columns of ``blocks``, taken from ``sources``.

    Both have entity, side, period, ym_index, label; ``keys`` (a fold, say) must
    be equal too. No earlier source: null, in counts too. A null period or entity
    has no history and is none; a null side has no same or opposite one, and is
    part of any side's history alone. A side that is neither of ``sides`` fails the
    job. ``hot``: entities that are scanned in two levels; by default those that
    ``scan.hot_values`` finds in both tables. Their month indexes are squared around
    ``centre``.
    """
    if hot is None:
        hot = scan.hot_values(sources) if targets is sources else scan.hot_values(targets, sources)
    if not hot:
        return _windowed(targets, sources, keys, blocks, sides, centre)
    often = scan.is_hot("entity", hot)
    few = targets.filter(~often)
    return _windowed(few, few if targets is sources else sources.filter(~often), keys, blocks, sides, centre).unionByName(
        _two_level(targets.filter(often), _by_period(sources.filter(often), keys, sides, centre), keys, blocks, sides, centre)
    )


def _windowed(targets: DataFrame, sources: DataFrame, keys: Sequence[str], blocks: Sequence[str], sides: Sequence[str], centre: int) -> DataFrame:
    """One window over the entity for all blocks: running sums of both sides and of each; a table that is its own source is not stacked."""
    names = ["entity", "side", "period", "ym_index", "label", *keys]
    known = F.col("period").isNotNull() & F.col("entity").isNotNull()
    own = known_side(F.col("side"), sides)
    if targets is sources:
        rows = targets.withColumns({"__target": F.lit(True), "__source": known})
    else:
        t = targets.withColumns({"__target": F.lit(True), "__source": F.lit(False)})
        rows = t.unionByName(sources.select(*names).filter(known).withColumns({"__target": F.lit(False), "__source": F.lit(True)}), allowMissingColumns=True)
    past = Window.partitionBy(*keys, "entity").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    y, label, source = F.col("ym_index"), F.col("label"), F.col("__source")
    c = y - centre
    each = dict(zip(_SUMS, (F.lit(1), F.when(y.isNotNull(), 1), y, c, c * c, F.when(label.isNotNull(), 1), label, label * label), strict=True))
    taken = {"any": source} if "any" in blocks else {}
    if "same" in blocks or "other" in blocks:
        taken |= {"A": source & (own == sides[0]), "B": source & (own == sides[1])}
    rows = rows.withColumns({f"__{b}__{n}": F.sum(F.when(use, v)).over(past) for b, use in taken.items() for n, v in each.items()}).filter("__target")
    for b, (mine, others) in (("same", "AB"), ("other", "BA")):
        if b in blocks:
            rows = rows.withColumns({f"__{b}__{n}": F.when(own == sides[0], F.col(f"__{mine}__{n}")).when(own == sides[1], F.col(f"__{others}__{n}")) for n in _SUMS})
    return _with_stats(rows, blocks).drop("__target", "__source", *[f"__{b}__{n}" for b in ("any", "same", "other", "A", "B") for n in _SUMS])


def _with_stats(rows: DataFrame, blocks: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``blocks`` from their sums ``__<block><sum>``."""

    def stats(b: str) -> list[Column]:
        n, yn, yt, y1, y2, ln, lt, l2 = (F.when(F.col("side").isNotNull() | F.lit(b == "any"), F.col(f"__{b}__{x}")) for x in _SUMS)
        y_n, l_n = F.nullif(yn, F.lit(0)), F.nullif(ln, F.lit(0))
        return [yt / y_n, F.when(yn > 0, yt), sample_std(yn, y1, y2), lt / l_n, F.when(ln > 0, lt), sample_std(ln, lt, l2), F.nullif(n, F.lit(0))]

    new = {}
    for b, out in (("any", ANY), ("same", SAME)):
        if b in blocks:
            new |= dict(zip(out, stats(b)[:6], strict=True))
    if "other" in blocks:
        mean, _, std, label, _, _, n = stats("other")
        new |= dict(zip(OTHER, (n, mean, std, label), strict=True))
    return rows.withColumns(new)


_SUMS = ("rows", "yn", "yt", "y1", "y2", "ln", "lt", "l2")


def _by_period(sources: DataFrame, keys: Sequence[str], sides: Sequence[str], centre: int) -> DataFrame:
    """keys, entity, side, period and ``_SUMS``: one row for all records of a period, added up before they are shuffled."""
    y, label = F.col("ym_index"), F.col("label")
    c = y - centre
    each = (F.count(F.lit(1)), F.count(y), F.sum(y), F.sum(c), F.sum(c * c), F.count(label), F.sum(label), F.sum(label * label))
    rows = sources.filter("period is not null and entity is not null").withColumn("side", known_side(F.col("side"), sides))
    return rows.groupBy(*keys, "entity", "side", "period").agg(*[v.alias("__" + n) for n, v in zip(_SUMS, each, strict=True)])


def _two_level(targets: DataFrame, collapsed: DataFrame, keys: Sequence[str], blocks: Sequence[str], sides: Sequence[str], centre: int) -> DataFrame:
    """What ``_windowed`` gives, from sources by period; targets look their period up, so a hot one is a join that Spark can split."""
    names, sums = [*keys, "entity", "side", "period"], ["__" + n for n in _SUMS]
    asked = targets.select(*names).distinct()
    own = F.col("side")
    rows = asked.withColumns({"__target": F.lit(True), "__look": flip(own, sides)}).unionByName(
        collapsed.withColumns({"__target": F.lit(False), "__look": own}), allowMissingColumns=True
    )
    rows = scan.with_ranges(rows, "period")
    group = {"any": [*keys, "entity"], "same": [*keys, "entity", "side"], "other": [*keys, "entity", "__look"]}
    for b in blocks:
        rows = scan.strict_sums(rows, group[b], "period", sums, f"__{b}")
    rows = rows.filter("__target").select(*[F.col(n).alias("__t_" + n) for n in names], *[F.col(f"__{b}{x}") for b in blocks for x in sums])
    held = targets.join(rows, scan.null_safe([(F.col(n), F.col("__t_" + n)) for n in names]), "left")
    return _with_stats(held, blocks).drop(*["__t_" + n for n in names], *[f"__{b}{x}" for b in blocks for x in sums])


def explode_folds(rows: DataFrame, fold: str, k: int) -> DataFrame:
    """Every row once in each of the folds 1..k, with its role there: valid in its own, train elsewhere."""
    out = rows.withColumnRenamed(fold, "__own").withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.withColumn("role", F.when(F.col("__own") == F.col(fold), "valid").otherwise("train")).drop("__own")


def fold_isolated(rows: DataFrame, fold: str = "fold", k: int = 5, centre: int = 24000, sides: Sequence[str] = SIDES, hot: Sequence | None = None, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """For each fold 1..k: ``rows`` (once a fold, with ``role``) with their history from the fold's training rows alone.

    Every row is a source of all folds but its own, so one pass over an entity's
    rows carries the sums of each fold, and rows are multiplied only behind it: a
    record is moved and sorted once, whatever k is. Sums of both sides are kept
    apart; a row then reads its own side's, the other one's, or all. Month indexes
    are summed as whole numbers around ``centre``. Nulls, ``sides`` and ``hot`` as in
    ``fold_history``. Of the history, ``columns`` are returned, and only the sums that
    they need are carried.
    """
    if hot is None:
        hot = scan.hot_values(rows)
    if not hot:
        return _folds_windowed(rows, fold, k, centre, sides, columns)
    often = scan.is_hot("entity", hot)
    few = rows.filter(often)
    own = _by_period(few, [fold], sides, centre).withColumnRenamed(fold, "__own").withColumn(fold, F.explode(F.sequence(F.lit(1), F.lit(k))))
    own = own.filter(~F.col("__own").eqNullSafe(F.col(fold))).groupBy(fold, "entity", "side", "period").agg(*[F.sum("__" + n).alias("__" + n) for n in _SUMS])
    held = _two_level(explode_folds(few, fold, k), own, [fold], ("any", "same", "other"), sides, centre).drop(*[c for c in FEATURES if c not in columns])
    return _folds_windowed(rows.filter(~often), fold, k, centre, sides, columns).unionByName(held)


#: The sums that each statistic of a block is made from.
_MADE_FROM = {"ym_mean": "n y", "ym_sum": "n y", "ym_std": "n y yy", "label_mean": "n l", "label_sum": "l", "label_std": "n l ll", "n": "n"}
#: The statistics of each block, in the order of its columns.
_OF_BLOCK = {"any": (ANY, tuple(_MADE_FROM)[:6]), "same": (SAME, tuple(_MADE_FROM)[:6]), "other": (OTHER, ("n", "ym_mean", "ym_std", "label_mean"))}


def _used(columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """block -> column -> statistic, of the blocks that ``columns`` are of."""
    used = {b: {c: stat for c, stat in zip(names, stats, strict=True) if c in columns} for b, (names, stats) in _OF_BLOCK.items()}
    return {b: stats for b, stats in used.items() if stats}


def _sums_of(columns: Sequence[str]) -> dict[str, list[str]]:
    """Of side A, side B and all records: the measures whose sums ``columns`` are made from."""
    used, measures = _used(columns), ("n", "y", "yy", "l", "ll")
    needed = lambda *blocks: {m for b in blocks for stat in used.get(b, {}).values() for m in _MADE_FROM[stat].split()}
    each = {"A": needed("same", "other"), "B": needed("same", "other"), "all": needed("any")}
    return {side: [m for m in measures if m in some] for side, some in each.items() if some}


def fold_sums(rows: DataFrame, fold: str = "fold", k: int = 5, centre: int = 24000, sides: Sequence[str] = SIDES, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """``rows``, each once, with ``__h<f>_<side>_<measure>``: of every fold 1..k the sums over an entity's earlier training rows that ``columns`` are made from.

    ``of_fold`` makes a fold's history of them. A window holds an entity, so hot ones (``scan.hot_values``) belong elsewhere.
    """
    past = Window.partitionBy("entity").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    known = F.col("period").isNotNull() & F.col("entity").isNotNull()
    c, label = F.col("ym_index").cast("long") - centre, F.col("label").cast("long")
    measures = {"n": F.lit(1).cast("long"), "y": c, "yy": c * c, "l": label, "ll": label * label}
    side = known_side(F.col("side"), sides)
    own = {"A": side == sides[0], "B": side == sides[1], "all": F.lit(True)}
    sums = {}
    for f in range(1, k + 1):
        for name, needed in _sums_of(columns).items():
            use = known & own[name] & ~F.col(fold).eqNullSafe(F.lit(f))
            sums |= {f"__h{f}_{name}_{m}": F.sum(F.when(use, measures[m])).over(past) for m in needed}
    return rows.withColumns(sums)


def of_fold(held: DataFrame, f: int, fold: str = "fold", k: int = 5, centre: int = 24000, sides: Sequence[str] = SIDES, columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """What ``fold_isolated`` gives for the fold ``f`` from the rows of ``fold_sums``: rows with ``role`` and ``columns``, all in the fold ``f``."""
    state = F.struct(*[F.struct(*[F.col(f"__h{f}_{name}_{m}").alias(m) for m in needed]).alias(name) for name, needed in _sums_of(columns).items()])
    rows = held.withColumn("__s", state).drop(*[f"__h{g}_{name}_{m}" for g in range(1, k + 1) for name, needed in _sums_of(columns).items() for m in needed])
    role = F.when(F.col(fold) == f, "valid").otherwise("train")
    return _from_state(rows.withColumns({"role": role, fold: F.lit(f)}), centre, sides, columns)


def _folds_windowed(rows: DataFrame, fold: str, k: int, centre: int, sides: Sequence[str], columns: Sequence[str]) -> DataFrame:
    sums = _sums_of(columns)
    held = fold_sums(rows, fold, k, centre, sides, columns)
    each = [F.struct(*[F.struct(*[F.col(f"__h{f}_{name}_{m}").alias(m) for m in needed]).alias(name) for name, needed in sums.items()]) for f in range(1, k + 1)]
    held = held.select(*rows.columns, F.posexplode(F.array(*each)).alias("__f", "__s"))
    role = F.when(F.col(fold) == F.col("__f") + 1, "valid").otherwise("train")
    held = held.withColumns({"role": role, fold: (F.col("__f") + 1).cast("int")}).drop("__f")
    return _from_state(held, centre, sides, columns)


def _from_state(held: DataFrame, centre: int, sides: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``held`` with ``columns`` from a row's sums ``__s``."""
    used, side = _used(columns), known_side(F.col("side"), sides)
    pick = lambda own: F.when(side == sides[0], F.col("__s.A" if own else "__s.B")).when(side == sides[1], F.col("__s.B" if own else "__s.A"))
    states = {"any": lambda: F.col("__s.all"), "same": lambda: pick(True), "other": lambda: pick(False)}
    held = held.withColumns({f"__{b}": states[b]() for b in used}).drop("__s")

    def stat(block: str, name: str) -> Column:
        v = {m: F.col(f"__{block}.{m}") for m in _MADE_FROM[name].split()}
        total = v["y"] + v["n"] * centre if "y" in v else None
        made = {
            "ym_mean": lambda: total / v["n"], "ym_sum": lambda: total, "ym_std": lambda: sample_std(v["n"], v["y"], v["yy"]),
            "label_mean": lambda: v["l"] / v["n"], "label_sum": lambda: v["l"], "label_std": lambda: sample_std(v["n"], v["l"], v["ll"]), "n": lambda: v["n"],
        }
        return made[name]()

    return held.withColumns({c: stat(b, name) for b, stats in used.items() for c, name in stats.items()}).drop(*[f"__{b}" for b in used])


def _any_differs(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return reduce(lambda x, y: x | y, [differs(a[c].cast("double"), b[c].cast("double")) for c in a])


def label_mutation(
    rows: DataFrame, mutate: Callable[[Column, Column], Column], fold: str = "fold", k: int = 5, centre: int = 24000, sides: Sequence[str] = SIDES, hot: Sequence | None = None
) -> DataFrame:
    """fold, row_id, changed: for each row of each fold 1..k, whether its history from the fold's training rows differs once labels are ``mutate(trains, label)``.

    ``trains`` is whether the record is a training row of the fold. Both histories are
    read from one pass over an entity's rows, side by side, so that nothing is joined
    and rows are multiplied only behind it. The columns compared are the seven that
    come from labels; counts and months read none, so both histories share them. Those
    of ``hot`` entities (as in ``fold_history``) are made apart, whole, and joined.
    """
    if hot is None:
        hot = scan.hot_values(rows)
    often = scan.is_hot("entity", hot)
    few = rows.filter(~often) if hot else rows
    known = F.col("period").isNotNull() & F.col("entity").isNotNull()
    few = few.select("row_id", "entity", "period", F.col(fold).alias("__own"), known_side(F.col("side"), sides).alias("__side"), F.when(known, F.col("label")).cast("long").alias("__label"))
    past = Window.partitionBy("entity").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    sums, keys = [], ("l", "ll", "m", "mm", "n", "mn")
    for f in range(1, k + 1):
        trains, each = ~F.col("__own").eqNullSafe(F.lit(f)), []
        x, y = F.col("__label"), mutate(trains, F.col("__label")).cast("long")
        for name, own in (("all", trains), ("A", trains & (F.col("__side") == sides[0])), ("B", trains & (F.col("__side") == sides[1]))):
            values = (x, x * x, y, y * y, F.when(x.isNotNull(), 1), F.when(y.isNotNull(), 1))
            each.append(F.struct(*[F.sum(F.when(own, v)).over(past).alias(m) for m, v in zip(keys, values, strict=True)]).alias(name))
        sums.append(F.struct(*each))
    held = few.select("row_id", "__side", F.array(*sums).alias("__h")).select("row_id", "__side", F.posexplode("__h").alias("__f", "__s"))
    pick = lambda own: F.when(F.col("__side") == sides[0], F.col("__s.A" if own else "__s.B")).when(F.col("__side") == sides[1], F.col("__s.B" if own else "__s.A"))
    held = held.select("row_id", "__f", F.col("__s.all").alias("any"), pick(True).alias("same"), pick(False).alias("other"))

    def columns(n: str, total: str, squares: str) -> dict[str, Column]:
        v = lambda b, m: F.col(f"{b}.{m}")
        out = {}
        for b, names in (("any", ANY), ("same", SAME)):
            out |= dict(zip(names[3:], (v(b, total) / F.nullif(v(b, n), F.lit(0)), v(b, total), sample_std(v(b, n), v(b, total), v(b, squares))), strict=True))
        return out | {OTHER[3]: v("other", total) / F.nullif(v("other", n), F.lit(0))}

    out = held.select((F.col("__f") + 1).cast("int").alias(fold), "row_id", _any_differs(columns("n", "l", "ll"), columns("mn", "m", "mm")).alias("changed"))
    if not hot:
        return out
    each = explode_folds(rows.filter(often), fold, k)
    other = each.withColumn("label", mutate(F.col("role") == "train", F.col("label")))
    made = [fold_history(x, x.filter("role = 'train'"), [fold], sides=sides, hot=hot, centre=centre).select(fold, "row_id", *FEATURES) for x in (each, other)]
    return out.unionByName(history_diff(*made, [fold, "row_id"]).select(fold, "row_id", "changed"))


def label_diff(rows: DataFrame, other: str, blocks: Sequence[str] = ("any",), hot: Sequence | None = None) -> DataFrame:
    """``rows`` with ``changed``: whether a row's history differs from the one with the labels in the column ``other``.

    The second history is read from the rows of the first as they lie, so rows are moved and sorted once.
    """
    hot = scan.hot_values(rows) if hot is None else hot
    names = [c for b in blocks for c in {"any": ANY, "same": SAME, "other": OTHER}[b]]
    one = fold_history(rows, rows, blocks=blocks, hot=hot)
    one = one.withColumnsRenamed({c: "__a_" + c for c in names} | {"label": "__label"}).withColumnRenamed(other, "label")
    two = fold_history(one, one, blocks=blocks, hot=hot)
    changed = _any_differs({c: F.col("__a_" + c) for c in names}, {c: F.col(c) for c in names})
    two = two.withColumn("changed", changed).withColumnRenamed("label", other).withColumnRenamed("__label", "label")
    return two.drop(*names, *["__a_" + c for c in names])


def static_history(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """``targets`` with mean, sum and std of all sources of the entity that precede the target's period.

    Aggregated once for each entity when its sources all precede all targets is
    cheaper, but nothing guarantees that: the strict rule is always applied.
    """
    return fold_history(targets, sources, blocks=("any",))


def month_state(rows: DataFrame, keys: Sequence[str] = ("entity",), centre: int = 24000) -> DataFrame:
    """Running state by entity and period: n, label_sum, ym_sum, ym_std of all records up to the period.

    Periods are collapsed before the window, so hot months cost one row each.
    """
    c = F.col("ym_index").cast("long") - centre
    month = rows.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"), F.sum(c).alias("s"), F.sum(c * c).alias("ss"), F.sum(F.col("ym_index").cast("long")).alias("ym_sum")
    )
    run = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    state = month.withColumns({x: F.sum(x).over(run) for x in ("n", "label_sum", "s", "ss", "ym_sum")})
    return state.withColumn("ym_std", sample_std(F.col("n"), F.col("s"), F.col("ss"))).drop("s", "ss")


def merge_state(targets: DataFrame, state: DataFrame, keys: Sequence[str] = ("entity",), columns: Sequence[str] | None = None, hot: Sequence | None = None) -> DataFrame:
    """``targets`` with ``columns`` of the latest row of ``state`` with equal ``keys`` and a smaller period; null where there is none.

    ``state`` has one row for each of its keys and periods; a null key or period is
    no state and finds none. Columns that both have come from ``state``, keys and
    period aside. Both are read sorted, once, through a frame that ends before the
    target's period. Targets whose first key is ``hot`` are asked by distinct periods
    and in two levels, and look the answer up.
    """
    columns = [c for c in state.columns if c not in (*keys, "period")] if columns is None else list(columns)
    if hot is None:
        hot = scan.hot_values(targets, state, column=keys[0])
    by = [*keys, "period"]
    empty = F.lit(None).cast(T.StructType([state.schema[c] for c in columns]))
    held = state.select(*by, F.struct(*columns).alias("__v")).filter(" and ".join(f"`{c}` is not null" for c in by))
    rest = targets.drop(*columns)

    def windowed(t: DataFrame, s: DataFrame) -> DataFrame:
        rows = t.withColumns({"__target": F.lit(True), "__v": empty}).unionByName(s.withColumn("__target", F.lit(False)), allowMissingColumns=True)
        past = Window.partitionBy(*keys).orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__last", F.last("__v", ignorenulls=True).over(past)).filter("__target").drop("__target", "__v")

    def looked_up(t: DataFrame, s: DataFrame) -> DataFrame:
        asked = t.select(*by).distinct().withColumns({"__target": F.lit(True), "__v": empty})
        rows = scan.with_ranges(asked.unionByName(s.withColumn("__target", F.lit(False))), "period")
        found = scan.strict_last(rows, list(keys), "period", "__v", "__last").filter("__target").select(*[F.col(c).alias("__t_" + c) for c in by], "__last")
        return t.join(found, scan.null_safe([(F.col(c), F.col("__t_" + c)) for c in by]), "left").drop(*["__t_" + c for c in by])

    if hot:
        often = scan.is_hot(keys[0], hot)
        out = windowed(rest.filter(~often), held.filter(~often)).unionByName(looked_up(rest.filter(often), held.filter(often)))
    else:
        out = windowed(rest, held)
    return out.select(*rest.columns, *[F.col("__last")[c].alias(c) for c in columns])


def theta_history(targets: DataFrame, sources: DataFrame, keys: Sequence[str] = (), sides: Sequence[str] = SIDES) -> DataFrame:
    """The same 16 columns by an independent plan: an equi-join on the entity with ``period <``, then groups. For audits of small sets."""
    s = sources.select(*[F.col(c).alias("s_" + c) for c in ("entity", "side", "period", "ym_index", "label", *keys)])
    on = (F.col("entity") == F.col("s_entity")) & (F.col("s_period") < F.col("period"))
    for k in keys:
        on = on & (F.col(k) == F.col("s_" + k))
    j = targets.join(s, on, "left")
    aggs = []
    for names, cond in ((ANY, F.lit(True)), (SAME, F.col("s_side") == F.col("side"))):
        for i, x in enumerate(("s_ym_index", "s_label")):
            v = F.when(cond, F.col(x))
            aggs += [f(v).alias(n) for n, f in zip(names[3 * i : 3 * i + 3], (F.avg, F.sum, F.stddev_samp), strict=True)]
    other = F.col("s_side") == flip(F.col("side"), sides)
    v = lambda x: F.when(other, F.col(x))
    aggs += [F.nullif(F.count(v("s_period")), F.lit(0)).alias(OTHER[0]), F.avg(v("s_ym_index")).alias(OTHER[1]), F.stddev_samp(v("s_ym_index")).alias(OTHER[2]), F.avg(v("s_label")).alias(OTHER[3])]
    return j.groupBy(*targets.columns).agg(*aggs)


def differs(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null-safe: one is null, or both are and differ by more than the tolerance."""
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def history_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """``keys`` of both and ``changed``: whether any of the columns differs; rows on one side only count as changed."""
    right = b.select(*[F.col(k).alias("__k_" + k) for k in keys], *[F.col(c).alias("__b_" + c) for c in columns])
    on = None
    for k in keys:
        on = (F.col(k) == F.col("__k_" + k)) if on is None else on & (F.col(k) == F.col("__k_" + k))
    both = a.join(right, on, "full")
    changed = F.col(keys[0]).isNull() | F.col("__k_" + keys[0]).isNull()
    for c in columns:
        changed = changed | differs(F.col(c).cast("double"), F.col("__b_" + c).cast("double"))
    return both.withColumn("changed", changed).drop(*["__k_" + k for k in keys], *["__b_" + c for c in columns])


#: The columns of each block.
BLOCKS = {"any": ANY, "same": SAME, "opposite": OTHER}


def history_diff_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], groups: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """groups, block, column, n, changed, changed_rate: how often each history column differs between ``a`` and ``b``, and (column null) any of its block.

    One join and one pass of counts; the counts of a group are unpivoted. ``groups``
    are columns of ``a``; rows on one side only count as changed.
    """
    right = b.select(*[F.col(k).alias("__k_" + k) for k in keys], *[F.col(c).alias("__b_" + c) for c in FEATURES])
    both = a.join(right, scan.null_safe([(F.col(k), F.col("__k_" + k)) for k in keys]), "full")
    alone = F.col(keys[0]).isNull() | F.col("__k_" + keys[0]).isNull()
    marks = {c: alone | differs(F.col(c).cast("double"), F.col("__b_" + c).cast("double"), tolerance) for c in FEATURES}
    both = both.select(*groups, *[m.alias(c) for c, m in marks.items()])
    counts = [F.count_if(F.col(c)).alias(c) for c in FEATURES] + [F.count_if(F.greatest(*cs)).alias("__" + block) for block, cs in BLOCKS.items()]
    one = both.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = [F.struct(F.lit(block).alias("block"), F.lit(c).cast("string").alias("column"), F.col(c or "__" + block).alias("changed")) for block, cs in BLOCKS.items() for c in (*cs, None)]
    return one.select(*groups, "n", F.explode(F.array(*rows)).alias("z")).select(*groups, "z.block", "z.column", "n", "z.changed", (F.col("z.changed") / F.col("n")).alias("changed_rate"))


def relative_time(rows: DataFrame) -> DataFrame:
    """Absolute month columns become gaps to the present: mean gap = now - mean, sum of gaps = n * now - sum; absolute ones go."""
    out = rows
    for p in ("prev_ab", "prev"):
        mean, total = F.col(f"{p}_YearMonthIndex_mean"), F.col(f"{p}_YearMonthIndex_sum")
        out = out.withColumns({f"{p}_month_gap_mean": F.col("ym_index") - mean, f"{p}_month_gap_sum": F.round(F.try_divide(total, mean)) * F.col("ym_index") - total})
    out = out.withColumn("other_test_month_gap_mean", F.col("ym_index") - F.col("other_test_YearMonthIndex_mean"))
    return out.drop(*[f"{p}_YearMonthIndex_{s}" for p in ("prev_ab", "prev") for s in ("mean", "sum")], "other_test_YearMonthIndex_mean", "ym_index", "period")
