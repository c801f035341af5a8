"""Registered queries: each takes (spark, folder of Parquet tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..functions.text import lenient_date
from ..operators import bitmaps, facetbits, facetcounts, facets, gramindex, maintenance, paging, postings, rankindex, selection, split, textindex
from ..operators.enrich import (
    FanOut,
    count_rows,
    distinct_products,
    enrich,
    filtered_ids,
    page_count,
    registry_for,
    with_code,
)
from ..operators.filters import FilterSpec
from ..operators.registrystore import RegistryStore
from ..schemas import COLETA, ENRICHED, ROSTER, add_missing_columns, conform, empty
from ..session import scratch_path, written
from ..sinks import clustered, colocated, export, publish, workbook
from ..sources import warehouse
from ..sources.tables import read_collection, register_views, run_query

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
SUPPLIER_CODE = "5"
SUPPLIER_NAME = "Supplier#000000005"
BRAND = "Brand#1"
PRICE_TYPE = "1-URGENT"
STATE = "NATION_7"
SINCE = "1998-01-01"
EAN = "0000000000016"
SKU = "SKU-16-6"
TERM = "RING"
WILD_TERM = "ring%brand_1"
PHRASE = "small ring"
PAGE = 2
SELECTED_BELOW = "PROD000020"
NAME = "Customer#000000042"
NOTE = "d'água; 100%"
SHOPS = [*derive.DOMAINS, "Outra Loja"]


def query(run: Query) -> Query:
    """Register under the function's name; a final underscore tells it from an import of that name."""
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def _view(spark: SparkSession, folder: str, spec: FilterSpec = FilterSpec()) -> DataFrame:
    fact = spec.apply(warehouse.collection(spark, folder))
    return enrich(fact, warehouse.registry(spark, folder), whole=True)


def _fact(spark: SparkSession, folder: str, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Filtered fact rows for queries that return no price type."""
    return spec.apply(warehouse.collection(spark, folder, price_type=spec.tipo_preco is not None))


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    """The selection: products with a number below 20."""
    products = _fact(spark, folder).select("id_produto").distinct()
    return products.where(F.col("id_produto") < SELECTED_BELOW)


SINCE_TERM = FilterSpec(data_apos=SINCE, busca_texto=TERM)
BRAND_SINCE_TERM = FilterSpec(marca=BRAND, data_apos=SINCE, busca_texto=TERM)


# --- sources and the enriched view --------------------------------------------------------


@query
def scan_collection(spark, folder):
    """All columns; the array of supplier codes as text and size, too."""
    rows = warehouse.collection(spark, folder)
    codes = rows.withColumns({"codigos": F.array_join("cod_informante", ","), "n_codigos": F.size("cod_informante")})
    return with_code(codes)


@query
def scan_flat(spark, folder):
    return with_code(conform(warehouse.flat_collection(spark, folder), COLETA))


@query
def scan_registry(spark, folder):
    return warehouse.registry(spark, folder)


@query
def enriched_base(spark, folder):
    return _view(spark, folder)


@query
def parse_collection_date(spark, folder):
    """Date text with some bad values, parsed leniently and shown day first."""
    number = F.substring("id_produto", 5, 20).cast("long")
    text = (
        F.when(number % 13 == 0, "xx")
        .when(number % 13 == 1, "")
        .when(number % 13 == 2, F.lit(None).cast("string"))
        .otherwise(F.col("data_coleta"))
    )
    parsed = _fact(spark, folder).select("id_coleta", "id_imagem", text.alias("texto"))
    return parsed.withColumn("data", F.date_format(lenient_date(F.col("texto")), "dd/MM/yyyy"))


# --- filters ------------------------------------------------------------------------------


def _filtered(name: str, **values: str) -> None:
    spec = FilterSpec(**values)
    QUERIES[name] = lambda spark, folder: _view(spark, folder, spec)


_filtered("filter_supplier_code", cod_informante=SUPPLIER_CODE)
_filtered("filter_supplier_name", nome_informante=SUPPLIER_NAME)
_filtered("filter_brand", marca=BRAND)
_filtered("filter_price_type", tipo_preco=PRICE_TYPE)
_filtered("filter_state", uf=STATE)
_filtered("filter_date_from", data_apos=SINCE)
_filtered("filter_description", busca_texto=TERM)
_filtered("filter_all", marca=BRAND, data_apos=SINCE, busca_texto=TERM)


@query
def filter_ean_sku(spark, folder):
    """One search by EAN and one by SKU, under each other."""
    by_ean = _view(spark, folder, FilterSpec(ean_sku=EAN))
    return by_ean.unionByName(_view(spark, folder, FilterSpec(ean_sku=f" {SKU} ")))


# --- counts, pages, facets ----------------------------------------------------------------


@query
def count_filtered(spark, folder):
    fan_out = FanOut(warehouse.registry(spark, folder))
    return count_rows(_fact(spark, folder, SINCE_TERM), fan_out)


@query
def page_count_(spark, folder):
    fan_out = FanOut(warehouse.registry(spark, folder))
    return page_count(count_rows(_fact(spark, folder, SINCE_TERM), fan_out), paging.PAGE_SIZE)


@query
def page_topk(spark, folder):
    return paging.page_topk(warehouse.collection(spark, folder), warehouse.registry(spark, folder), PAGE)


@query
def page_row_number(spark, folder):
    return paging.page_row_number(warehouse.collection(spark, folder), warehouse.registry(spark, folder), PAGE)


def _days(spark, folder) -> paging.DayIndex:
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    return paging.DayIndex(fact, registry, counted=_fact(spark, folder))


def _part_of_the_way(view: paging.DayIndex | rankindex.RankIndex, part: int, of: int) -> int:
    """The page that lies this part of the way through the whole view."""
    total = view.total() if callable(view.total) else view.total
    return max(1, -(-total // paging.PAGE_SIZE) * part // of)


@query
def page_deep(spark, folder):
    days = _days(spark, folder)
    return days.page(_part_of_the_way(days, 5, 6))


@query
def page_deep_by_rank(spark, folder):
    """A deep page found by ranges of the order, as for days too large for top-k."""
    days = _days(spark, folder)
    return days.page(_part_of_the_way(days, 1, 2), top_k_rows=8)


@query
def count_and_page(spark, folder):
    """The main screen with filters: the number of rows and a page, from one count per day."""
    fact = SINCE_TERM.apply(warehouse.collection(spark, folder))
    total, page = paging.count_and_page(fact, warehouse.registry(spark, folder), PAGE)
    return page.withColumn("cnt", F.lit(total).cast("long"))


@query
def page_after(spark, folder):
    """The page after the second one, from the second one's last row."""
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    last = paging.page_topk(fact, registry, PAGE).collect()[-1]
    return paging.page_after(fact, registry, last.asDict())


@query
def page_before(spark, folder):
    """The page before the second one, from the second one's first row."""
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    first = paging.page_topk(fact, registry, PAGE).first()
    return paging.page_before(fact, registry, first.asDict())


@query
def page_first(spark, folder):
    """The main screen: filtered by date and text, first page, newest first."""
    fact = SINCE_TERM.apply(warehouse.collection(spark, folder))
    page = paging.get_page(fact, warehouse.registry(spark, folder), 1)
    return page.withColumn("data_coleta", F.col("data_coleta").cast("string"))


@query
def facet_values(spark, folder):
    return facets.facet_values(warehouse.collection(spark, folder))


@query
def facet_supplier_code(spark, folder):
    return facets.supplier_codes(_fact(spark, folder))


@query
def facet_options(spark, folder):
    return facets.filter_options(warehouse.collection(spark, folder))


@query
def facet_date_bounds(spark, folder):
    return facets.date_bounds(_fact(spark, folder))


@query
def distinct_products_(spark, folder):
    return distinct_products(_fact(spark, folder))


# --- selection ----------------------------------------------------------------------------


@query
def all_filtered_ids(spark, folder):
    return filtered_ids(_fact(spark, folder, SINCE_TERM), FanOut(warehouse.registry(spark, folder)))


@query
def selection_select_all(spark, folder):
    return selection.select_all(_selected(spark, folder), _fact(spark, folder, BRAND_SINCE_TERM))


def _edited(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection, the ids on the page, and those of them marked: the even product numbers."""
    fact = warehouse.collection(spark, folder)
    page = paging.page_topk(fact, warehouse.registry(spark, folder), PAGE).select("id_produto")
    even = F.substring("id_produto", 5, 20).cast("long") % 2 == 0
    return _selected(spark, folder), page, page.where(even)


@query
def selection_reconcile(spark, folder):
    return selection.reconcile(*_edited(spark, folder))


@query
def selection_deselected(spark, folder):
    _, page, chosen = _edited(spark, folder)
    return selection.deselected(page, chosen)


@query
def selection_changed(spark, folder):
    before, page, chosen = _edited(spark, folder)
    return selection.changed(before, selection.reconcile(before, page, chosen))


@query
def selection_all_flag(spark, folder):
    fact = _fact(spark, folder, FilterSpec(marca=BRAND))
    total = count_rows(fact, FanOut(warehouse.registry(spark, folder)))
    return selection.all_selected(_selected(spark, folder), fact, total)


@query
def count_selected(spark, folder):
    return selection.count_selected(_selected(spark, folder))


@query
def selection_clear(spark, folder):
    """The box for all rows unticked twice: by the count everything is selected in the first case only."""
    fact = _fact(spark, folder, BRAND_SINCE_TERM)
    some = _selected(spark, folder)
    everything = _fact(spark, folder).select("id_produto").distinct()
    total = count_rows(fact, FanOut(warehouse.registry(spark, folder)))
    sizes = [selection.count_selected(selection.toggle_all(s, fact, total, False)) for s in (everything, some)]
    return sizes[0].unionByName(sizes[1])


@query
def mark_selected(spark, folder):
    return selection.mark_selected(_view(spark, folder), _selected(spark, folder))


def _everything_found(spark, folder) -> DataFrame:
    """The selection of the exports: all products that the search by date and term finds."""
    return selection.select_all(selection.cleared(_fact(spark, folder)), _fact(spark, folder, SINCE_TERM))


def _picked(spark, folder) -> DataFrame:
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    return selection.rows_by_ids(fact, registry, _everything_found(spark, folder))


@query
def rows_by_ids(spark, folder):
    return _picked(spark, folder)


# --- selections as bitmaps ---------------------------------------------------------------


def _numbered(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The products' numbers and the fact table that carries them, both stored."""
    fact = warehouse.collection(spark, folder)
    numbers = written(bitmaps.number_products(_fact(spark, folder)), "numeros")
    return numbers, written(bitmaps.with_numbers(fact, numbers), "numerada")


def _edited_bitmaps(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The numbers, and the sets of :func:`_edited` as bitmaps."""
    numbers, fact = _numbered(spark, folder)
    page = paging.page_topk(fact.drop(bitmaps.NUMBER), warehouse.registry(spark, folder), PAGE).select("id_produto")
    page = bitmaps.with_numbers(page, numbers)
    even = F.substring("id_produto", 5, 20).cast("long") % 2 == 0
    sets = fact.where(F.col("id_produto") < SELECTED_BELOW), page, page.where(even)
    return numbers, *map(bitmaps.bitmap, sets)


@query
def selection_select_all_bitmap(spark, folder):
    numbers, fact = _numbered(spark, folder)
    some = bitmaps.bitmap(fact.where(F.col("id_produto") < SELECTED_BELOW))
    return bitmaps.ids(bitmaps.select_all(some, bitmaps.bitmap(BRAND_SINCE_TERM.apply(fact))), numbers)


@query
def selection_reconcile_bitmap(spark, folder):
    numbers, selected, page, chosen = _edited_bitmaps(spark, folder)
    return bitmaps.ids(bitmaps.reconcile(selected, page, chosen), numbers)


@query
def selection_deselected_bitmap(spark, folder):
    numbers, _, page, chosen = _edited_bitmaps(spark, folder)
    return bitmaps.ids(bitmaps.deselected(page, chosen), numbers)


@query
def selection_changed_bitmap(spark, folder):
    _, selected, page, chosen = _edited_bitmaps(spark, folder)
    return bitmaps.changed(selected, bitmaps.reconcile(selected, page, chosen))


@query
def selection_all_flag_bitmap(spark, folder):
    _, fact = _numbered(spark, folder)
    wanted = FilterSpec(marca=BRAND).apply(fact)
    total = count_rows(wanted, FanOut(warehouse.registry(spark, folder)))
    some = bitmaps.bitmap(fact.where(F.col("id_produto") < SELECTED_BELOW))
    return bitmaps.all_selected(some, bitmaps.bitmap(wanted), total)


@query
def rows_by_bitmap(spark, folder):
    """Everything the search finds is selected, and its rows are picked by their numbers."""
    _, fact = _numbered(spark, folder)
    return bitmaps.picked(fact, warehouse.registry(spark, folder), bitmaps.bitmap(SINCE_TERM.apply(fact)))


# --- export and publishing ----------------------------------------------------------------


@query
def export_formatted(spark, folder):
    """The export's rows. Labels lose their dots here, which a plain column reference cannot hold."""
    rows = export.formatted(_picked(spark, folder))
    return rows.toDF(*[c.replace(".", "") for c in rows.columns])


def _unsorted(spark, folder) -> DataFrame:
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    return selection.picked(fact, registry, _everything_found(spark, folder))


@query
def export_widths(spark, folder):
    return export.column_widths(_unsorted(spark, folder))


@query
def export_labels(spark, folder):
    return export.filled_columns(_unsorted(spark, folder))


@query
def export_workbook(spark, folder):
    """The export as one workbook file, read back: its rows and their places."""
    paths = workbook.write_workbook(_picked(spark, folder), scratch_path(spark, "pasta"))
    return workbook.read_rows(spark, paths, {f.name: f.dataType.simpleString() for f in ENRICHED})


@query
def publish_enriched(spark, folder):
    path = scratch_path(spark, "enriquecida")
    publish.publish(_view(spark, folder), path)
    return publish.read_published(spark, path)


# --- stored tables --------------------------------------------------------------------------


def _stored(spark, folder) -> DataFrame:
    """The fact table written by month and read back."""
    path = scratch_path(spark, "coleta")
    publish.publish(warehouse.collection(spark, folder), path)
    return read_collection(spark, path)


@query
def stored_filter(spark, folder):
    fact = BRAND_SINCE_TERM.apply(_stored(spark, folder))
    return enrich(fact, warehouse.registry(spark, folder))


@query
def stored_page_deep(spark, folder):
    """A deep page of a stored table by its stored index of ranks."""
    fact, registry, path = _stored(spark, folder), warehouse.registry(spark, folder), scratch_path(spark, "postos")
    rankindex.write_rank_index(fact, FanOut(registry), path)
    index = rankindex.RankIndex(spark, path, fact, registry)
    return index.page(_part_of_the_way(index, 5, 6))


@query
def stored_page_refreshed(spark, folder):
    """The same after some months were published again: at first without the rows of a brand, then in full."""
    path, index_path = scratch_path(spark, "coleta"), scratch_path(spark, "postos")
    fact, registry = warehouse.collection(spark, folder), warehouse.registry(spark, folder)
    fan_out = FanOut(registry)
    publish.publish(fact.where((F.col("marca") != BRAND) | (F.col("data_coleta") < SINCE)), path)
    rankindex.write_rank_index(read_collection(spark, path), fan_out, index_path)
    publish.publish(FilterSpec(data_apos=SINCE).apply(fact), path)
    rankindex.write_rank_index(FilterSpec(data_apos=SINCE).apply(read_collection(spark, path)), fan_out, index_path)
    index = rankindex.RankIndex(spark, index_path, read_collection(spark, path), registry)
    index.check(fan_out)
    return index.page(_part_of_the_way(index, 1, 3))


@query
def stored_options(spark, folder):
    path = scratch_path(spark, "opcoes")
    facets.write_options(warehouse.collection(spark, folder), path)
    return facets.read_options(spark, path)


@query
def stored_options_changed(spark, folder):
    """Filter options after months were replaced and rows appended and removed, from the stored counts alone."""
    fact, path = warehouse.collection(spark, folder), scratch_path(spark, "contagens")
    older, newer, brand = F.col("data_coleta") < SINCE, F.col("data_coleta") >= SINCE, F.col("marca") == BRAND
    facetcounts.replace_months(fact.where(older & ~brand), path)
    wrong = fact.where(newer & brand).withColumn("uf", F.lit("errada"))
    facetcounts.add_rows(wrong, path)
    facetcounts.add_rows(fact.where(older & brand), path)
    facetcounts.replace_months(fact.where(newer), path)
    for sign in (1, -1):
        facetcounts.add_rows(wrong, path, sign)
    return facetcounts.stored_options(spark, path)


@query
def stored_clustered_filter(spark, folder):
    """A filter on the table stored along the curve of its filter columns."""
    path = scratch_path(spark, "curva")
    clustered.publish_clustered(warehouse.collection(spark, folder), path)
    fact = FilterSpec(uf=STATE).apply(read_collection(spark, path))
    return enrich(fact, warehouse.registry(spark, folder))


@query
def stored_enriched(spark, folder):
    """The view of both tables stored in buckets of their join key, one brand appended later."""
    fact, path = warehouse.collection(spark, folder), scratch_path(spark, "juntas")
    store = colocated.ColocatedStore(spark, "juntas_" + path.rsplit("-", 1)[-1], path)
    try:
        store.create(fact.where(F.col("marca") != BRAND), warehouse.registry(spark, folder))
        store.append(fact.where(F.col("marca") == BRAND))
        return store.enriched()
    finally:
        store.drop()


def _bits(spark, folder) -> facetbits.FacetBits:
    """The fact stored by month with bitmaps of its filter values."""
    table, path = scratch_path(spark, "coleta"), scratch_path(spark, "marcas")
    publish.publish(warehouse.collection(spark, folder), table)
    facetbits.write_facet_bits(spark, table, path, FanOut(warehouse.registry(spark, folder)))
    return facetbits.FacetBits(spark, table, path)


@query
def count_filtered_stored(spark, folder):
    """Counts of filters by facet and date, from bitmaps alone."""
    bits = _bits(spark, folder)
    specs = [FilterSpec(uf=STATE, data_apos=SINCE), FilterSpec(marca=BRAND, tipo_preco=PRICE_TYPE), FilterSpec(cod_informante=SUPPLIER_CODE), FilterSpec()]
    counts = [bits.count(spec).select(F.lit(i).alias("filtro"), "cnt") for i, spec in enumerate(specs)]
    return reduce(DataFrame.unionAll, counts)


@query
def stored_filter_files(spark, folder):
    """A filter by state, date and text: only files in which the bitmaps find rows are read."""
    bits = _bits(spark, folder)
    found = written(bits.rows(FilterSpec(uf=STATE, data_apos=SINCE, busca_texto=TERM)), "achadas")
    return enrich(found, registry_for(found, warehouse.registry(spark, folder)))


@query
def stored_index_lookup(spark, folder):
    """The search by words in the stored index of blocks, of which a brand was added later."""
    fact, path = _fact(spark, folder), scratch_path(spark, "blocos")
    postings.write_postings(fact.where(F.col("marca") != BRAND), path)
    postings.extend_postings(fact.where(F.col("marca") == BRAND), path)
    return postings.search(spark, path, PHRASE)


@query
def stored_index_rows(spark, folder):
    """The same search in an index with one row per posting."""
    path = scratch_path(spark, "indice")
    textindex.write_index(textindex.build_index(_fact(spark, folder)), path)
    return textindex.search(textindex.read_index(spark, path, PHRASE), PHRASE)


@query
def stored_description_search(spark, folder):
    """The search by text through the stored index of grams."""
    fact, path = warehouse.collection(spark, folder), scratch_path(spark, "gramas")
    gramindex.write_gram_index(_fact(spark, folder), path)
    return enrich(gramindex.search(fact, path, TERM), warehouse.registry(spark, folder))


@query
def stored_search_extended(spark, folder):
    """The same, some rows appended after the index was made; the term has a wildcard."""
    fact, path = _fact(spark, folder), scratch_path(spark, "gramas")
    gramindex.write_gram_index(fact.where(F.col("marca") == BRAND), path)
    gramindex.extend_gram_index(fact.where(F.col("marca") != BRAND), path)
    found = gramindex.search(warehouse.collection(spark, folder), path, WILD_TERM)
    return enrich(found, warehouse.registry(spark, folder))


@query
def append_rows(spark, folder):
    """A batch appended twice: the numbers written, and what is read back."""
    path, rows = scratch_path(spark, "anexada"), BRAND_SINCE_TERM.apply(warehouse.collection(spark, folder))
    first, second = publish.append_rows(rows, path), publish.append_rows(rows, path)
    back = read_collection(spark, path).agg(F.count("*").alias("lidas"))
    return back.select(F.lit(first).cast("long").alias("primeira"), F.lit(second).cast("long").alias("segunda"), "lidas")


@query
def insert_from_select(spark, folder):
    """Suppliers' names and codes inserted into a catalogue table, columns in another order."""
    path = scratch_path(spark, "inserida")
    name = "inserida_" + path.rsplit("-", 1)[-1]
    spark.sql(f"create table {name} (nome_informante string, cod_informante string) using parquet location '{path}'")
    try:
        rows = with_code(_fact(spark, folder)).select("cod_informante", "nome_informante").distinct()
        publish.insert_from(rows, name)
    finally:
        spark.sql(f"drop table {name}")
    return spark.read.schema("nome_informante string, cod_informante string").parquet(path)


# --- SQL over the views ---------------------------------------------------------------------


def _views(spark, folder) -> None:
    register_views(warehouse.collection(spark, folder), warehouse.registry(spark, folder))


@query
def sql_bound_values(spark, folder):
    """SQL with bound values, one of which holds a quote."""
    _views(spark, folder)
    text = "select *, :nota as nota from enriquecida where marca = :marca and data_coleta >= :desde"
    return run_query(spark, text, marca=BRAND, desde=SINCE, nota=NOTE)


@query
def sql_subquery(spark, folder):
    """A filtered query as the source of another."""
    _views(spark, folder)
    inner = "select id_produto, cod_insumo from enriquecida where uf = :uf"
    text = f"select cod_insumo is not null as codificado, count(*) as linhas from ({inner}) as sub group by all"
    return run_query(spark, text, uf=STATE)


@query
def empty_relation(spark, folder):
    """A filtered view on the empty relation: its columns and types fit, its rows are none."""
    return empty(spark).unionByName(_view(spark, folder, BRAND_SINCE_TERM))


# --- registry and keyed maintenance -------------------------------------------------------


@query
def coverage_registry(spark, folder):
    return maintenance.coverage_registry(warehouse.registry(spark, folder))


@query
def coverage_enriched(spark, folder):
    return maintenance.coverage_enriched(_fact(spark, folder), warehouse.registry(spark, folder))


@query
def registry_roster(spark, folder):
    return maintenance.listing(warehouse.roster(spark, folder))


@query
def registry_display(spark, folder):
    return maintenance.display(warehouse.roster(spark, folder))


@query
def registry_lookup_active(spark, folder):
    return maintenance.lookup_active(warehouse.roster(spark, folder), NAME)


@query
def registry_exists(spark, folder):
    """Whether an active row has a name, and whether one has a name that is not there."""
    roster = warehouse.roster(spark, folder)
    there = maintenance.exists_flag(maintenance.lookup_active(roster, NAME))
    return there.unionByName(maintenance.exists_flag(maintenance.lookup_active(roster, NAME + "?")))


@query
def registry_first(spark, folder):
    """The first row of the listing."""
    return maintenance.listing(warehouse.roster(spark, folder)).limit(1)


@query
def registry_insert_new(spark, folder):
    return maintenance.insert_new(warehouse.roster(spark, folder), warehouse.insert_batch(spark, folder))


@query
def registry_rejects(spark, folder):
    return maintenance.insert_rejects(warehouse.roster(spark, folder), warehouse.insert_batch(spark, folder))


@query
def registry_delete_protected(spark, folder):
    return maintenance.delete_keys(warehouse.roster(spark, folder), warehouse.delete_batch(spark, folder))


@query
def registry_delete_outcomes(spark, folder):
    return maintenance.delete_outcomes(warehouse.roster(spark, folder), warehouse.delete_batch(spark, folder))


@query
def registry_update_keyed(spark, folder):
    changes = warehouse.update_batch(spark, folder)
    return maintenance.update_keyed(warehouse.roster(spark, folder), changes, ["email", "area"])


@query
def registry_update_outcomes(spark, folder):
    return maintenance.update_outcomes(warehouse.roster(spark, folder), warehouse.update_batch(spark, folder))


@query
def registry_constraint_audit(spark, folder):
    """The roster together with an insert batch, before any check."""
    batch = warehouse.insert_batch(spark, folder).withColumn("ativo", F.lit(1)).drop("seq")
    return maintenance.constraint_audit(warehouse.roster(spark, folder).unionByName(batch), {"area": 7})


@query
def registry_add_column(spark, folder):
    """A roster of an older shape brought up to date."""
    older = warehouse.roster(spark, folder).drop("area", "ativo")
    return add_missing_columns(older, ROSTER, {"ativo": 1}).select(*ROSTER.fieldNames())


@query
def registry_merge_stored(spark, folder):
    """The stored roster after an update, a deletion and an insertion, each of which rewrites touched files only."""
    store = RegistryStore(spark, scratch_path(spark, "cadastro"))
    store.create(warehouse.roster(spark, folder))
    store.update(warehouse.update_batch(spark, folder), ["email", "area"])
    store.delete(warehouse.delete_batch(spark, folder))
    store.insert(warehouse.insert_batch(spark, folder))
    return store.read()


# --- derivations --------------------------------------------------------------------------


def _items(spark, folder) -> DataFrame:
    """Line items with a shop name by supplier, one name in seven unknown to the domain table."""
    shops = F.array(*[F.lit(s) for s in SHOPS])
    return warehouse.table(spark, folder, "lineitem").withColumn(
        "plataforma", F.get(shops, (F.col("l_suppkey") % len(SHOPS)).cast("int"))
    )


def _derived_sku():
    return derive.sku(F.col("plataforma"), F.col("l_partkey") % 90000 + 10000, F.col("l_orderkey"))


@query
def derive_sku(spark, folder):
    return _items(spark, folder).select("l_orderkey", "l_linenumber", _derived_sku().alias("sku"))


@query
def derive_url(spark, folder):
    link = derive.url(F.col("plataforma"), _derived_sku())
    return _items(spark, folder).select("l_orderkey", "l_linenumber", link.alias("url"))


@query
def derive_description(spark, folder):
    text = derive.description(F.col("p_name"), F.col("p_brand"), F.col("p_size"))
    return warehouse.table(spark, folder, "part").select("p_partkey", text.alias("descricao"))


@query
def derive_promo_price(spark, folder):
    factor = (F.col("l_partkey") % 26 + 70).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")
    on_offer = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 3
    promo = derive.promo_price(F.col("l_extendedprice"), factor, on_offer)
    return warehouse.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("preco"), promo.alias("preco_promocional")
    )


@query
def derive_ids(spark, folder):
    return warehouse.table(spark, folder, "lineitem").select(
        derive.product_id(F.col("l_partkey")).alias("id_produto"),
        derive.collection_id(F.col("l_orderkey") % 9000 + 1000).alias("id_coleta"),
        derive.image_id(F.col("l_orderkey") % 90000 + 10000).alias("id_imagem"),
    )


@query
def derive_collection_date(spark, folder):
    days = F.col("l_orderkey") % (derive.DAY_SPAN + 1)
    return warehouse.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", derive.collection_date(days).alias("data_coleta")
    )


@query
def split_proportional(spark, folder):
    pairs = with_code(_fact(spark, folder)).where("cod_informante is not null")
    return split.split_keys(pairs, ["cod_informante", "id_produto"])


@query
def product_refs_explode(spark, folder):
    return split.product_references(distinct_products(_fact(spark, folder)))


# --- text index ---------------------------------------------------------------------------


@query
def text_index_build(spark, folder):
    return textindex.build_index(_fact(spark, folder))


@query
def text_index_lookup(spark, folder):
    return textindex.search(textindex.build_index(_fact(spark, folder)), PHRASE)
