"""Pages of the enriched view, newest first, at any depth or after a row already seen."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lenient_date, supplier_code
from ..schemas import MONTH, VISIBLE_COLUMNS
from ..session import durable
from .enrich import REGISTRY_TIES, FanOut, enrich, enrich_first

PAGE_SIZE = 30

# Ranks up to here are found by top-k, where each task keeps this many rows at most.
TOP_K_ROWS = 900

# Values by which a range of ranks is split at a time.
SPLITTERS = 64

_DAY_LENGTH = len("yyyy-MM-dd")
_IS_DAY = re.compile(r"\d{4}-(0[1-9]|1[0-2])-\d{2}", re.ASCII)
_DATE = "data_coleta"

# The order: the date descending, then all other columns ascending, the registry's last. Rows that
# are equal on all of them cannot be told apart. Rows equal on the fact's meet the same registry rows.
_FIRST_TIES = ("id_coleta", "id_imagem", "id_produto", "nome_informante", "preco", "cod_informante")
_FACT_KEYS = (
    _DATE,
    *_FIRST_TIES,
    *(c for c in VISIBLE_COLUMNS if c not in (_DATE, *_FIRST_TIES, *REGISTRY_TIES)),
)
_KEYS = (*_FACT_KEYS, *REGISTRY_TIES)


def _value(rows: DataFrame, key: str) -> Column:
    return supplier_code(rows) if key == "cod_informante" else F.col(key)


def _sorted_by(rows: DataFrame, keys: Sequence[str], backward: bool = False) -> list[Column]:
    order = []
    for key in keys:
        value = _value(rows, key)
        if backward:
            order.append(value.asc_nulls_first() if key == _DATE else value.desc_nulls_first())
        else:
            order.append(value.desc_nulls_last() if key == _DATE else value.asc_nulls_last())
    return order


def newest_first(rows: DataFrame) -> DataFrame:
    """Enriched rows in display order: a range-partitioned sort, parallel also within one hot day."""
    return rows.orderBy(*_sorted_by(rows, _KEYS))


def all_newest_first(rows: DataFrame) -> DataFrame:
    """Many enriched rows in display order. A last key that differs everywhere lets copies of a row be split."""
    place = rows.withColumn("_place", F.monotonically_increasing_id())
    return place.orderBy(*_sorted_by(place, _KEYS), "_place").drop("_place")


# --- order as conditions ------------------------------------------------------------------


def _later(value: Column, key: str, than: object) -> Column:
    """Whether a value comes after another in display order."""
    if than is None:
        return F.lit(False)
    return (value < F.lit(than) if key == _DATE else value > F.lit(than)) | value.isNull()


def _sooner(value: Column, key: str, than: object) -> Column:
    """Whether a value comes before another in display order."""
    if than is None:
        return value.isNotNull()
    found = value > F.lit(than) if key == _DATE else value < F.lit(than)
    return F.coalesce(found, F.lit(False))


def _from_row(rows: DataFrame, keys: Sequence[str], seen: Mapping, backward: bool) -> Column:
    """Rows that come after ``seen`` in display order (before it, if ``backward``) or equal it."""
    beyond = _sooner if backward else _later
    found = F.lit(True)
    for key in reversed(keys):
        value = _value(rows, key)
        found = beyond(value, key, seen[key]) | (value.eqNullSafe(F.lit(seen[key])) & found)
    return found


def _day() -> Column:
    """The day of the date text: its first characters, which sort like the whole text."""
    return F.substring(_DATE, 1, _DAY_LENGTH)


def _between_days(fact: DataFrame, newest: str | None, oldest: str | None) -> DataFrame:
    """Fact rows from the newest to the oldest day; NULL is the oldest.

    Plain comparisons, so that they reach the scan; on a table by month both ends prune months.
    """
    date, conditions = F.col(_DATE), []
    if newest is None:
        return fact.where(date.isNull())
    older = date <= F.lit(newest)
    if len(newest) == _DAY_LENGTH:
        # The day's own texts may go on after it, such as with a time.
        older = older | date.startswith(newest)
    conditions.append(older if oldest is not None else older | date.isNull())
    if oldest is not None:
        conditions.append(date >= F.lit(oldest))
    if MONTH in fact.columns:
        month = F.col(MONTH)
        # Blank and NULL dates have no month.
        conditions.append(month <= F.lit(newest[:7]) if oldest else (month <= F.lit(newest[:7])) | month.isNull())
        if oldest:
            conditions.append(month >= F.lit(oldest[:7]))
    return fact.where(reduce(and_, conditions))


# --- shallow pages ------------------------------------------------------------------------


def page_ranks(page: int, size: int = PAGE_SIZE) -> tuple[int, int]:
    """Ranks (after, up to) of a page; pages count from 1."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return (page - 1) * size, page * size


def _first_rows(fact: DataFrame, registry: DataFrame, n: int, backward: bool = False) -> DataFrame:
    """Enriched rows among which the first ``n`` of the whole view are (the last, if ``backward``)."""
    first = fact.orderBy(*_sorted_by(fact, _FACT_KEYS, backward)).limit(n)
    return enrich_first(first, registry, n, backward)


def _newest(fact: DataFrame, n: int) -> DataFrame:
    """Fact rows of the newest days that hold ``n`` rows.

    The oldest of those days is found from the filter columns and the date alone, so that the
    table is read in full width, and joined, only from that day on.
    """
    days = _hit(day_counts(fact), 0, n)
    return _between_days(fact, days[0].day, days[-1].day) if days else fact


def page_topk(
    fact: DataFrame, registry: DataFrame, page: int, size: int = PAGE_SIZE, *, fan_out: FanOut | None = None
) -> DataFrame:
    """A page by sort, offset and limit, which Spark runs as top-k; deep ones by :func:`page_deep`."""
    after, upto = page_ranks(page, size)
    if upto > TOP_K_ROWS:
        return page_deep(fact, registry, page, size, fan_out=fan_out)
    return newest_first(_first_rows(_newest(fact, upto), registry, upto)).offset(after).limit(size)


def page_row_number(
    fact: DataFrame, registry: DataFrame, page: int, size: int = PAGE_SIZE, *, fan_out: FanOut | None = None
) -> DataFrame:
    """A page by row number, helper column dropped. The rank bound makes Spark run it as top-k."""
    after, upto = page_ranks(page, size)
    if upto > TOP_K_ROWS:
        return page_deep(fact, registry, page, size, fan_out=fan_out)
    rows = _first_rows(_newest(fact, upto), registry, upto)
    ranked = rows.withColumn("_rn", F.row_number().over(Window.orderBy(*_sorted_by(rows, _KEYS))))
    return ranked.where((F.col("_rn") > after) & (F.col("_rn") <= upto)).drop("_rn")


# --- pages next to a row ------------------------------------------------------------------


def _reach(day: str, months: int) -> str:
    """The first or last text of the month that lies so many months from a day; the day's own month for 0."""
    month = int(day[:4]) * 12 + int(day[5:7]) - 1 + months
    return f"{month // 12:04d}-{month % 12 + 1:02d}"


def _walk(day: str, backward: bool) -> Iterator[tuple[str | None, str | None]]:
    """(newest, oldest) day or month bounds from a day on, ever wider: the day, its month, 1, 3, 7... months on."""
    yield (day, day)
    for months in (0, 1, 3, 7, 15, 31, 63):
        # A prefix sorts before all texts that begin with it, a prefix and "~" after them.
        yield (_reach(day, months) + "~", day) if backward else (day, _reach(day, -months))


def _alongside(fact: DataFrame, keys: Sequence[str], seen: Mapping, need: int, backward: bool) -> DataFrame:
    """Fact rows from ``seen`` on, bounded on both sides by dates between which there are ``need`` of them.

    A table by month is probed outward from the seen day; each probe reads a few months' keys and stops at
    ``need`` rows. Else the rows per day are counted, from the filter columns and the date alone.
    """
    date = seen[_DATE]
    beyond = _from_row(fact, keys, seen, backward)
    day = None if date is None else date[:_DAY_LENGTH]
    if MONTH in fact.columns and day and _IS_DAY.fullmatch(day):
        for newest, oldest in _walk(day, backward):
            near = _within(fact, newest, oldest).where(beyond)
            if near.limit(need).count() >= need:
                return near
        return (_within(fact, None, day) if backward else _within(fact, day, None)).where(beyond)
    # The seen day is always read; of the days beyond it, as many as hold the page.
    others = (_sooner if backward else _later)(_day(), _DATE, day)
    side = fact if not day else _within(fact, None, day) if backward else _within(fact, day, None)
    far = _far_day(day_counts(side.where(others)), need, backward, day)
    return _between_days(fact, *((far, day) if backward else (day, far))).where(beyond)


def _within(fact: DataFrame, newest: str | None, oldest: str | None) -> DataFrame:
    """Fact rows between two texts that are days or months, ends included; None is no bound."""
    date, conditions = F.col(_DATE), []
    month = F.col(MONTH) if MONTH in fact.columns else None
    if newest is not None:
        older = date <= F.lit(newest)
        conditions.append(older | date.startswith(newest) if len(newest) == _DAY_LENGTH else older)
        if oldest is None:
            conditions[-1] = conditions[-1] | date.isNull()
        if month is not None:
            last = month <= F.lit(newest[:7])
            conditions.append(last if oldest is not None else last | month.isNull())
    if oldest is not None:
        conditions.append(date >= F.lit(oldest))
        if month is not None:
            conditions.append(month >= F.lit(oldest[:7]))
    return fact.where(reduce(and_, conditions, F.lit(True)))


def _far_day(counts: DataFrame, need: int, backward: bool, seen: str | None) -> str | None:
    """The last day, from the nearest on, of those that hold ``need`` rows; the seen one if there are none."""
    order = F.asc_nulls_last("dia") if backward else F.desc_nulls_last("dia")
    running = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = counts.withColumn("antes", running - F.col("n")).where(F.col("antes") < need)
    last = hit.orderBy(F.desc("antes")).limit(1).collect()
    return last[0].dia if last else seen


def _beside(fact: DataFrame, registry: DataFrame, seen: Mapping, size: int, shown: int, backward: bool) -> DataFrame:
    if size < 1 or shown < 0:
        raise ValueError("size starts at 1, shown at 0")
    need = shown + size
    near = _alongside(fact, _FACT_KEYS, seen, need, backward)
    first = durable(near.orderBy(*_sorted_by(near, _FACT_KEYS, backward)).limit(need))
    same = reduce(and_, (_value(first, k).eqNullSafe(F.lit(seen[k])) for k in _FACT_KEYS))
    # Copies of the fact row that was seen: some of their registry rows may lie on the other side.
    copies = enrich_first(first.where(same), registry.where(_from_row(registry, REGISTRY_TIES, seen, backward)), need, backward)
    rows = copies.unionByName(enrich_first(first.where(~same), registry, need, backward))
    beside = rows.orderBy(*_sorted_by(rows, _KEYS, backward)).offset(shown).limit(size)
    return newest_first(beside)


def page_after(fact: DataFrame, registry: DataFrame, last: Mapping, size: int = PAGE_SIZE, shown: int = 1) -> DataFrame:
    """The rows that follow a page, given its last row (a mapping of the visible columns).

    ``shown``: how many rows equal to it in all columns were shown so far; more than one only if the
    table has copies. The rows are read between two dates, the row's own and one beyond which the page
    cannot reach, so no rank is counted.
    """
    return _beside(fact, registry, last, size, shown, backward=False)


def page_before(fact: DataFrame, registry: DataFrame, first: Mapping, size: int = PAGE_SIZE, shown: int = 1) -> DataFrame:
    """The rows that precede a page, given its first row; ``shown`` as for :func:`page_after`, from this row on."""
    return _beside(fact, registry, first, size, shown, backward=True)


# --- deep pages ---------------------------------------------------------------------------


class Day(NamedTuple):
    """A day with its number of rows and the number of rows before it."""

    day: str | None
    before: int
    rows: int


def day_counts(fact: DataFrame, fan_out: FanOut | None = None) -> DataFrame:
    """Rows (dia, n): the view's rows per day, from the filter columns and the date alone.

    Without ``fan_out`` fact rows are counted.
    """
    counts = fact.groupBy(_day().alias("dia")).agg(F.count("*").alias("n"))
    extra = fan_out.extra(fact, _day().alias("dia")) if fan_out else None
    if extra is None:
        return counts
    more = extra.groupBy("dia").agg(F.sum("linhas").alias("n"))
    return counts.unionByName(more).groupBy("dia").agg(F.sum("n").alias("n"))


def _hit(counts: DataFrame, after: int, upto: int) -> list[Day]:
    """The days that hold a rank, newest first: no more than there are ranks."""
    newest = Window.orderBy(F.desc_nulls_last("dia"))
    running = F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = counts.withColumn("antes", running - F.col("n")).where(
        (F.col("antes") < upto) & (F.col("antes") + F.col("n") > after)
    )
    return [Day(r.dia, r.antes, r.n) for r in hit.orderBy("antes").collect()]


class _Part(NamedTuple):
    """One step into a range of the order: a key, and a value or an open interval of its values."""

    key: str
    pinned: bool
    low: object  # the value if pinned, else the interval's start, None for none
    high: object

    def holds(self, rows: DataFrame) -> Column:
        value = _value(rows, self.key)
        if self.pinned:
            return value.eqNullSafe(F.lit(self.low))
        found = value.isNotNull()
        if self.low is not None:
            found = found & _later(value, self.key, self.low)
        return found if self.high is None else found & _sooner(value, self.key, self.high)

    def ends_before(self, rows: DataFrame) -> Column:
        """Whether a row comes after all of the step's values."""
        value = _value(rows, self.key)
        if self.pinned:
            return _later(value, self.key, self.low)
        return value.isNull() if self.high is None else ~_sooner(value, self.key, self.high)

    def starts_after(self, rows: DataFrame) -> Column:
        """Whether a row comes before all of the step's values."""
        value = _value(rows, self.key)
        if self.pinned:
            return _sooner(value, self.key, self.low)
        return F.lit(False) if self.low is None else value.isNotNull() & ~_later(value, self.key, self.low)


class _Range(NamedTuple):
    """A range of the order: its steps, the number of rows before it and in it, and whether it is one fact row's copies."""

    parts: tuple[_Part, ...]
    before: int
    rows: int
    copies: bool

    def within(self, rows: DataFrame) -> DataFrame:
        return rows.where(reduce(and_, (p.holds(rows) for p in self.parts), F.lit(True)))

    def outside(self, rows: DataFrame, after: bool) -> Column:
        """Whether a row comes after the range, or before it."""
        found, same = F.lit(False), F.lit(True)
        for p in self.parts:
            found = found | (same & (p.ends_before(rows) if after else p.starts_after(rows)))
            same = same & p.holds(rows)
        return found


class _Ranks:
    """Finds the rows at given ranks of the order by halving, 64 ways at a time.

    Each step draws a few values of the next key from the rows in question and counts the rows between
    them: two narrow scans and no sort, however many rows there are.
    """

    def __init__(self, fact: DataFrame, registry: DataFrame, fan_out: FanOut, total: int, enough: int):
        self.fact, self.registry, self.fan_out, self.total, self.enough = fact, registry, fan_out, total, enough
        self.known: dict[tuple[_Part, ...], list[tuple[_Part, int]]] = {}

    def _split(self, parts: tuple[_Part, ...], key: str) -> list[tuple[_Part, int]]:
        """The steps by ``key`` into a range, in order, with their numbers of rows."""
        if parts in self.known:
            return self.known[parts]
        rows = _Range(parts, 0, 0, False).within(self.fact)
        value = _value(rows, key)
        drawn = rows.select(value.alias("v"), F.xxhash64(*[_value(rows, k) for k in _FACT_KEYS]).alias("h"))
        drawn = drawn.where("v is not null").orderBy("h").limit(SPLITTERS).select("v").distinct()
        order = F.col("v").desc() if key == _DATE else F.col("v").asc()
        values = [r.v for r in drawn.orderBy(order).collect()]
        ends = [None, *values, None]
        steps = [_Part(key, False, ends[0], ends[1])]
        for i, v in enumerate(values, 1):
            steps += [_Part(key, True, v, v), _Part(key, False, v, ends[i + 1])]
        steps.append(_Part(key, True, None, None))

        def place(first: int, last: int) -> Column:
            """The step of a value among splitters first to last - 1, as a decision tree."""
            if first == last:
                return F.lit(2 * first)
            middle = (first + last) // 2
            at = values[middle]
            return (
                F.when(value == F.lit(at), 2 * middle + 1)
                .when(_sooner(value, key, at), place(first, middle))
                .otherwise(place(middle + 1, last))
            )

        step = F.when(value.isNull(), len(steps) - 1).otherwise(place(0, len(values)))
        rows = rows.withColumn("passo", step)
        counts = rows.groupBy("passo").agg(F.count("*").alias("n"))
        extra = self.fan_out.extra(rows, "passo")
        if extra is not None:
            counts = counts.unionByName(extra.groupBy("passo").agg(F.sum("linhas").alias("n")))
        found = {r.passo: r.n for r in counts.groupBy("passo").agg(F.sum("n").alias("n")).collect()}
        self.known[parts] = [(s, found[i]) for i, s in enumerate(steps) if i in found]
        return self.known[parts]

    def range_of(self, rank: int) -> _Range:
        """A range with the row of a rank (counted from 0): few enough rows for top-k, or copies of one."""
        parts, before, rows, at = (), 0, self.total, 0
        while rows > self.enough and at < len(_FACT_KEYS):
            for step, n in self._split(parts, _FACT_KEYS[at]):
                if rank < before + n:
                    break
                before += n
            parts, rows, at = (*parts, step), n, at + step.pinned
        return _Range(parts, before, rows, at == len(_FACT_KEYS))

    def _slice(self, found: _Range, after: int, upto: int) -> DataFrame:
        """The rows at ranks after+1..upto of a range."""
        rows = found.within(self.fact)
        if not found.copies or found.rows <= self.enough:
            return newest_first(_first_rows(rows, self.registry, upto)).offset(after).limit(upto - after)
        # Copies of one fact row: its registry rows follow each other, each as often as the fact row is there.
        one = durable(enrich(rows.limit(1), self.registry).groupBy(*VISIBLE_COLUMNS).agg(F.count("*").alias("_m")))
        copies = rows.count()
        upto_row = Window.orderBy(*_sorted_by(one, REGISTRY_TIES)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.sum(F.col("_m") * copies).over(upto_row)
        ranked = one.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_m") * copies + 1)
        ranked = ranked.withColumns(
            {"_first": F.greatest("_first", F.lit(after + 1)), "_last": F.least("_last", F.lit(upto))}
        ).where("_first <= _last")
        return ranked.withColumn("_rn", F.explode(F.sequence("_first", "_last"))).select(*VISIBLE_COLUMNS)

    def page(self, after: int, upto: int) -> DataFrame:
        """The rows at ranks after+1..upto, of which there are some."""
        upto = min(upto, self.total)
        low, high = self.range_of(after), self.range_of(upto - 1)
        if low.parts == high.parts:
            return newest_first(self._slice(low, after - low.before, upto - low.before))
        head = self._slice(low, after - low.before, low.rows)
        tail = self._slice(high, 0, upto - high.before)
        between = self.fact.where(low.outside(self.fact, after=True) & high.outside(self.fact, after=False))
        return newest_first(head.unionByName(enrich(between, self.registry)).unionByName(tail))


def _page_of(
    fact: DataFrame, registry: DataFrame, fan_out: FanOut, days: list[Day], after: int, upto: int, top_k_rows: int
) -> DataFrame:
    if not days:
        return enrich(fact, registry).where(F.lit(False))
    first, last = days[0], days[-1]
    rows = _between_days(fact, first.day, last.day)
    total = last.before + last.rows - first.before
    after, upto = after - first.before, min(upto - first.before, total)
    enough = min(top_k_rows, TOP_K_ROWS)
    if upto <= enough:
        return newest_first(_first_rows(rows, registry, upto)).offset(after).limit(upto - after)
    return _Ranks(rows, registry, fan_out, total, max(enough, 1)).page(after, upto)


class DayIndex:
    """The view's rows per day, counted once: the number of all rows, and pages at any depth.

    ``counted`` may give the same fact rows by a cheaper plan; only their dates and keys are counted.
    """

    def __init__(
        self, fact: DataFrame, registry: DataFrame, *, fan_out: FanOut | None = None, counted: DataFrame | None = None
    ):
        self.fact, self.registry, self.fan_out = fact, registry, FanOut.of(registry, fan_out)
        self.counts = durable(day_counts(fact if counted is None else counted, self.fan_out))
        self.total: int = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, page: int, size: int = PAGE_SIZE, *, top_k_rows: int = TOP_K_ROWS) -> DataFrame:
        """A page: only the days on it are read, and found by top-k or, for high ranks, by :class:`_Ranks`."""
        after, upto = page_ranks(page, size)
        days = _hit(self.counts, after, upto)
        return _page_of(self.fact, self.registry, self.fan_out, days, after, upto, top_k_rows)


def page_deep(
    fact: DataFrame,
    registry: DataFrame,
    page: int,
    size: int = PAGE_SIZE,
    *,
    fan_out: FanOut | None = None,
    top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """A page at any depth: a first pass counts rows per day, later ones read only the days on the page."""
    page_ranks(page, size)
    return DayIndex(fact, registry, fan_out=fan_out).page(page, size, top_k_rows=top_k_rows)


def count_and_page(
    fact: DataFrame, registry: DataFrame, page: int, size: int = PAGE_SIZE, *, fan_out: FanOut | None = None
) -> tuple[int, DataFrame]:
    """The number of rows of the view and one of its pages, both from one count per day."""
    index = DayIndex(fact, registry, fan_out=fan_out)
    return index.total, index.page(page, size)


def get_page(
    fact: DataFrame, registry: DataFrame, page: int, size: int = PAGE_SIZE, *, fan_out: FanOut | None = None
) -> DataFrame:
    """The page of the main screen at any depth, the date parsed leniently."""
    rows = page_topk(fact, registry, page, size, fan_out=fan_out)
    return rows.withColumn(_DATE, lenient_date(F.col(_DATE)))
