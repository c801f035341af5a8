"""Batch change sets on a keyed table, its audit and listing; registration coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, labelled, or_dash
from ..schemas import ROSTER
from .enrich import KEY, registry_by_text_key, with_code

# The allowed types with their labels, the types that need an e-mail, the protected type.
TYPE_LABELS = {"master": "Master", "administrador": "Administrador", "tecnico": "Técnico"}
TYPES_WITH_EMAIL = ("administrador", "tecnico")
PROTECTED_TYPE = "master"

ROSTER_COLUMNS = ROSTER.fieldNames()


# --- listing and lookup -------------------------------------------------------------------


def listing(roster: DataFrame) -> DataFrame:
    """The roster's columns by type and name."""
    return roster.select(*ROSTER_COLUMNS).orderBy("tipo", "nome")


def display(roster: DataFrame) -> DataFrame:
    """Labels for types, a dash where e-mail or area is absent."""
    return roster.select(
        "id",
        "nome",
        or_dash(F.col("email")).alias("email"),
        labelled(F.col("tipo"), TYPE_LABELS).alias("tipo"),
        or_dash(F.col("area")).alias("area"),
    )


def lookup_active(roster: DataFrame, name: str) -> DataFrame:
    """The active row of a name, if any."""
    return roster.where((F.col("nome") == F.lit(name)) & (F.col("ativo") == 1))


def exists_flag(rows: DataFrame) -> DataFrame:
    """One row ``existe``: whether there is any row."""
    return rows.limit(1).agg((F.count("*") > 0).alias("existe"))


def exists(rows: DataFrame) -> bool:
    """Whether there is any row; reads until the first one."""
    return not rows.isEmpty()


# --- change sets --------------------------------------------------------------------------


def _insert_fault() -> Column:
    """First rule a new row breaks, NULL when none."""
    return (
        F.when(F.col("nome").isNull(), "nome_obrigatorio")
        .when(F.col("tipo").isin(*TYPES_WITH_EMAIL) & F.col("email").isNull(), "email_obrigatorio")
        .when(~F.coalesce(F.col("tipo").isin(*TYPE_LABELS), F.lit(False)), "tipo_invalido")
    )


def _checked(batch: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rows cleaned and checked; per free name the first valid ``seq``; of those, per free id the first.

    Names are settled before ids: a row that loses its id does not free its name for a later one.
    """
    clean = batch.withColumns({c: blank_to_null(F.col(c)) for c in ("nome", "email", "area")})
    checked = clean.withColumn("motivo", _insert_fault())
    named = (
        checked.where(F.col("motivo").isNull())
        .groupBy("nome")
        .agg(F.min_by(F.struct("id", "seq"), "seq").alias("_r"))
        .select("nome", "_r.*")
        .join(roster.select("nome"), "nome", "left_anti")
    )
    winners = (
        named.groupBy("id")
        .agg(F.min_by(F.struct("nome", "seq"), "seq").alias("_r"))
        .select("id", "_r.*")
        .join(roster.select("id"), "id", "left_anti")
    )
    return checked, named, winners


def accepted_rows(roster: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch (``seq`` unique, in order of arrival) that are inserted.

    Joining the winners on name and ``seq`` spreads the copies of an often repeated name.
    """
    checked, _, winners = _checked(batch, roster)
    accepted = checked.join(winners.select("nome", "seq"), ["nome", "seq"], "left_semi").withColumn("ativo", F.lit(1))
    return accepted.select(*ROSTER_COLUMNS)


def insert_new(roster: DataFrame, batch: DataFrame) -> DataFrame:
    """The roster with the accepted rows of a batch."""
    return roster.select(*ROSTER_COLUMNS).unionByName(accepted_rows(roster, batch))


def insert_rejects(roster: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch that are not inserted, with the reason."""
    checked, named, winners = _checked(batch, roster)
    rejected = checked.join(winners.select("nome", "seq"), ["nome", "seq"], "left_anti")
    named = named.select("nome", "seq", F.lit("id_em_uso").alias("_id"))
    reason = F.coalesce("motivo", "_id", F.lit("ja_existe"))
    return rejected.join(named, ["nome", "seq"], "left").select("id", "nome", reason.alias("motivo"))


def _protected() -> Column:
    return F.col("tipo").eqNullSafe(F.lit(PROTECTED_TYPE))


def delete_keys(roster: DataFrame, keys: DataFrame) -> DataFrame:
    """The roster without the given ids; protected rows stay."""
    asked = keys.select("id").distinct().withColumn("_pedido", F.lit(True))
    rows = roster.join(asked, "id", "left")
    return rows.where(F.col("_pedido").isNull() | _protected()).select(*ROSTER_COLUMNS)


def delete_outcomes(roster: DataFrame, keys: DataFrame) -> DataFrame:
    """Per id asked for: removed, or why not. An id that several rows have is removed if one of them goes."""
    asked = keys.select("id").distinct()
    found = roster.groupBy("id").agg(F.bool_or(~_protected()).alias("_sai"))
    return asked.join(found, "id", "left").select(
        "id",
        F.when(F.col("_sai").isNull(), "nao_encontrado")
        .when(F.col("_sai"), "removido")
        .otherwise("protegido")
        .alias("resultado"),
    )


def update_keyed(roster: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The roster after the changes of each id, one after the other by ``seq``; a NULL leaves the old value.

    So each of ``columns`` gets its last value that is not NULL. Only active rows are changed.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns]
    rows = roster.join(changes.groupBy("id").agg(*last), "id", "left")
    new = {c: F.when(F.col("ativo") == 1, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in columns}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in ROSTER_COLUMNS])


def update_outcomes(roster: DataFrame, changes: DataFrame) -> DataFrame:
    """Per id in a change set: updated, or not found among the active rows."""
    found = roster.where("ativo = 1").select("id", F.lit(True).alias("_achado"))
    return (
        changes.select("id")
        .distinct()
        .join(found, "id", "left")
        .select("id", F.when(F.col("_achado"), "alterado").otherwise("nao_encontrado").alias("resultado"))
    )


# --- audit --------------------------------------------------------------------------------


def _occurring_twice(rows: DataFrame, key: Column, rule: str) -> DataFrame:
    repeated = rows.where(key.isNotNull()).groupBy(key.alias("chave")).agg(F.count("*").alias("n"))
    return repeated.where("n > 1").agg(F.count("*").alias("violacoes")).select(F.lit(rule).alias("regra"), "violacoes")


def constraint_audit(rows: DataFrame, least_length: Mapping[str, int] | None = None) -> DataFrame:
    """Rows (regra, violacoes): rows against each rule, and for uniqueness keys and names that occur more than once.

    ``least_length``: columns whose text, if there is any, must have so many characters; none by default.
    """
    name = blank_to_null(F.col("nome"))
    needs_email = F.col("tipo").isin(*TYPES_WITH_EMAIL)
    rules = {
        "id_obrigatorio": F.col("id").isNull(),
        "nome_obrigatorio": name.isNull(),
        **{f"{c}_curto": F.length(blank_to_null(F.col(c))) < n for c, n in (least_length or {}).items()},
        "tipo_obrigatorio": F.col("tipo").isNull(),
        "tipo_invalido": ~F.col("tipo").isin(*TYPE_LABELS),
        "email_obrigatorio": needs_email & blank_to_null(F.col("email")).isNull(),
        "ativo_obrigatorio": F.col("ativo").isNull(),
    }
    counted = rows.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    listed = counted.select(
        F.inline(F.array(*[F.struct(F.lit(r).alias("regra"), F.col(r).alias("violacoes")) for r in rules]))
    )
    unique = _occurring_twice(rows, F.col("id"), "id_unico").unionByName(_occurring_twice(rows, name, "nome_unico"))
    return listed.unionByName(unique)


# --- coverage -----------------------------------------------------------------------------


def _code_class() -> Column:
    """Which codes a registry row carries; zero and empty text count as missing."""
    has_code = F.coalesce(F.col("cod_insumo") != "", F.lit(False))
    has_number = F.coalesce(F.col("insumo_informado") != 0, F.lit(False))
    return F.when(~has_code, "nenhum").when(has_number, "ambos").otherwise("so_insumo")


def coverage_registry(registry: DataFrame) -> DataFrame:
    """Registry rows by the codes they carry."""
    return registry.groupBy(_code_class().alias("classe")).agg(F.count("*").alias("linhas"))


def coverage_enriched(fact: DataFrame, registry: DataFrame) -> DataFrame:
    """Enriched rows by the codes they carry.

    Both sides are counted per key before they meet, so a key that holds much of the fact table
    is one row of the join.
    """
    prices = with_code(fact).groupBy(*KEY).agg(F.count("*").alias("_n"))
    codes = (
        registry_by_text_key(registry)
        .groupBy(*KEY, _code_class().alias("classe"))
        .agg(F.count("*").alias("_m"))
    )
    return (
        prices.join(codes, KEY, "left")
        .groupBy(F.coalesce("classe", F.lit("nenhum")).alias("classe"))
        .agg(F.sum(F.col("_n") * F.coalesce("_m", F.lit(1))).alias("linhas"))
    )
