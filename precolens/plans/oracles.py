"""For each registered query the same result in DuckDB SQL over the given tables."""

from __future__ import annotations

from ..schemas import COLUMN_LABELS, VISIBLE_COLUMNS

COLETA = """
coleta as (
  select strftime(l.l_shipdate, '%Y-%m-%d') as data_coleta,
         l.l_returnflag as plataforma,
         case when l.l_suppkey % 17 = 0 then cast([] as varchar[]) else [cast(l.l_suppkey as varchar), 'ALT'] end as codigos,
         codigos[1] as cod_informante,
         s.s_name as nome_informante,
         l.l_linestatus as periodicidade,
         o.o_orderpriority as tipo_preco,
         lpad(cast(l.l_partkey as varchar), cast(greatest(13, length(cast(l.l_partkey as varchar))) as int), '0') as ean,
         concat('SKU-', l.l_partkey, '-', l.l_linenumber) as sku,
         concat('https://www.example.com/produto/sku/', l.l_partkey, '/', l.l_linenumber) as url,
         concat(p.p_name, ' ', p.p_brand, ' ', p.p_size) as descricao,
         p.p_brand as marca,
         n.n_name as uf,
         case l.l_partkey % 3 when 0 then 'BRL' when 1 then 'USD' else 'EUR' end as moeda,
         l.l_extendedprice as preco,
         case when l.l_discount > 0.07::double then l.l_extendedprice * (1 - l.l_discount) end as preco_promocional,
         concat('PROD', lpad(cast(l.l_partkey as varchar), cast(greatest(6, length(cast(l.l_partkey as varchar))) as int), '0')) as id_produto,
         concat('COL', l.l_orderkey) as id_coleta,
         concat('IMG', l.l_orderkey, '_', l.l_linenumber) as id_imagem,
         l.l_partkey as numero
  from lineitem l
  join part p on p.p_partkey = l.l_partkey
  join supplier s on s.s_suppkey = l.l_suppkey
  join nation n on n.n_nationkey = s.s_nationkey
  left join orders o on o.o_orderkey = l.l_orderkey
)"""

CADASTRO = """
cadastro as (
  select l_suppkey as cod_informante,
         concat('PROD', lpad(cast(l_partkey as varchar), cast(greatest(6, length(cast(l_partkey as varchar))) as int), '0')) as id_produto_site,
         case when (l_partkey + l_suppkey) % 10 < 7 then concat('INS', l_partkey) end as cod_insumo,
         case when (l_partkey + l_suppkey) % 10 < 4 then cast(100000 + l_partkey as bigint) end as insumo_informado
  from (select distinct l_suppkey, l_partkey from lineitem)
  where (l_partkey + l_suppkey) % 10 < 9
)"""

_SOURCE = {"cod_insumo": "cb", "insumo_informado": "cb"}

ENRIQUECIDA = f"""
enriquecida as (
  select {", ".join(f"{_SOURCE.get(c, 'cp')}.{c}" for c in VISIBLE_COLUMNS)}, cp.numero
  from coleta cp
  left join cadastro cb on cast(cb.cod_informante as varchar) = cp.cod_informante
                       and cb.id_produto_site = cp.id_produto
)"""

VISIBLE = ", ".join(VISIBLE_COLUMNS)

ROSTER = """
roster as (
  select c_custkey as id,
         c_name as nome,
         case when c_custkey % 5 = 0 then '' else concat(lower(replace(c_name, '#', '.')), '@example.com') end as email,
         case c_mktsegment when 'BUILDING' then 'master' when 'MACHINERY' then 'administrador'
              when 'FURNITURE' then 'tecnico' else lower(c_mktsegment) end as tipo,
         case when c_custkey % 4 <> 0 then concat('AREA-', c_nationkey) end as area,
         cast(case when c_custkey % 11 = 0 then 0 else 1 end as int) as ativo
  from customer
)"""

INSERT_BATCH = """
novos as (
  select id as seq, case when id % 13 = 0 then id when id % 17 = 0 then 10000000 else id + 10000000 end as id,
         case when id % 35 = 0 then '  ' when id % 14 = 0 then concat(' ', nome)
              else concat('Novo-', id // 28) end as nome,
         email, tipo, area
  from roster where id % 7 = 0
),
limpos as (
  select seq, id, nullif(trim(nome), '') as nome, nullif(trim(email), '') as email, tipo,
         nullif(trim(area), '') as area
  from novos
),
conferidos as (
  select *, case when nome is null then 'nome_obrigatorio'
                 when tipo in ('administrador', 'tecnico') and email is null then 'email_obrigatorio'
                 when tipo not in ('master', 'administrador', 'tecnico') then 'tipo_invalido' end as falta
  from limpos
),
nomeados as (
  select *, case when falta is not null then falta
                 when nome in (select nome from roster) then 'ja_existe'
                 when row_number() over (partition by nome, falta is null order by seq) > 1 then 'ja_existe' end as sem_nome
  from conferidos
),
vistos as (
  select *, case when sem_nome is not null then sem_nome
                 when id in (select id from roster) then 'id_em_uso'
                 when row_number() over (partition by id, sem_nome is null order by seq) > 1 then 'id_em_uso' end as motivo
  from nomeados
)"""

UPDATE_BATCH = """
mudancas as (
  select id * 2 as seq, case when id % 3 = 0 then id + 20000000 else id end as id,
         email || '.br' as email, 'primeira' as area
  from roster where id % 7 = 1
  union all
  select id * 2 + 1, case when id % 3 = 0 then id + 20000000 else id end, null, 'segunda'
  from roster where id % 7 = 1 and id % 2 = 0
),
-- the changes applied one after the other
ordenadas as (select *, row_number() over (partition by id order by seq) as passo from mudancas),
aplicadas as (
  select r.id, 0 as passo, r.email, r.area from roster r where r.ativo = 1
  union all
  select a.id, o.passo, coalesce(o.email, a.email), coalesce(o.area, a.area)
  from aplicadas a join ordenadas o on o.id = a.id and o.passo = a.passo + 1
),
finais as (select * from aplicadas qualify row_number() over (partition by id order by passo desc) = 1)"""

DELETE_BATCH = """
pedidos as (
  select distinct case when id % 3 = 0 then id + 30000000 else id end as id from roster where id % 7 = 2
)"""

_ORDER = [
    "id_coleta", "id_imagem", "id_produto", "nome_informante", "preco", "cod_informante", "plataforma", "periodicidade",
    "tipo_preco", "ean", "sku", "url", "descricao", "marca", "uf", "moeda", "preco_promocional", "cod_insumo",
    "insumo_informado",
]
ORDEM = "data_coleta desc nulls last, " + ", ".join(f"{c} nulls last" for c in _ORDER)

SINCE_TERM = "data_coleta >= '1998-01-01' and lower(descricao) like '%ring%'"


def _fact(body: str) -> str:
    return f"with {COLETA} {body}"


def _view(body: str) -> str:
    return f"with {COLETA}, {CADASTRO}, {ENRIQUECIDA} {body}"


def _rows(condition: str) -> str:
    return _view(f"select {VISIBLE} from enriquecida where {condition}")


def _ranks(condition: str, ranks: str) -> str:
    return _view(
        f", ordenada as (select {VISIBLE}, row_number() over (order by {ORDEM}) as _rn, count(*) over () as _n "
        f"from enriquecida where {condition}) select {VISIBLE} from ordenada where {ranks}"
    )


def _part_of_the_way(part: int, of: int) -> str:
    first = f"greatest(1, cast(ceil(_n / 30) as bigint) * {part} // {of})"
    return f"_rn > 30 * ({first} - 1) and _rn <= 30 * {first}"


def _roster(body: str, *batches: str) -> str:
    return f"with recursive {', '.join([ROSTER, *batches])} {body}"


_SELECTED = "numero < 20"
_FOUND = f"id_produto in (select id_produto from coleta where {SINCE_TERM})"

_PAGE = f", pagina as (select id_produto, numero from (select *, row_number() over (order by {ORDEM}) as _rn from enriquecida) where _rn > 30 and _rn <= 60), escolhidos as (select distinct id_produto from coleta where {_SELECTED})"

_RECONCILED = (
    "select id_produto from pagina where numero % 2 = 0 union "
    "(select id_produto from escolhidos except select id_produto from pagina where id_produto not in "
    "(select id_produto from pagina where numero % 2 = 0))"
)


def _price(column: str) -> str:
    return (
        f"case when {column} is not null then 'R$ ' || "
        f"format('{{:,.2f}}', cast(cast(cast({column} as varchar) as decimal(18,2)) as double)) end"
    )


def _exported(column: str) -> str:
    if column in ("preco", "preco_promocional"):
        value = _price(column)
    elif column == "data_coleta":
        value = "strftime(cast(data_coleta as date), '%d/%m/%Y')"
    else:
        value = column
    label = COLUMN_LABELS[column].replace(".", "")
    return f'{value} as "{label}"'


_WIDTHS = " union all ".join(
    f"select '{label}' as coluna, cast(least(greatest(coalesce(max(length(cast({c} as varchar))), 0), "
    f"length('{label}')) + 4, 60) as int) as largura from enriquecida where {_FOUND}"
    for c, label in COLUMN_LABELS.items()
)

_FILLED = " union all ".join(
    f"select '{c}' as coluna, '{label}' as rotulo, count({c}) as preenchidas from enriquecida where {_FOUND}"
    for c, label in COLUMN_LABELS.items()
)

_CLASS = """case when coalesce(cod_insumo, '') = '' then 'nenhum'
                 when coalesce(insumo_informado, 0) = 0 then 'so_insumo' else 'ambos' end"""

_SHOP = """case l_suppkey % 7 when 0 then 'Mercado Livre' when 1 then 'Amazon' when 2 then 'Shopee'
           when 3 then 'Americanas' when 4 then 'Magazine Luiza' when 5 then 'Casas Bahia' else 'Outra Loja' end"""

_SHOP_PREFIX = """case l_suppkey % 7 when 0 then 'MER' when 1 then 'AMA' when 2 then 'SHO'
           when 3 then 'AME' when 4 then 'MAG' when 5 then 'CAS' else 'OUT' end"""

_SHOP_DOMAIN = """case l_suppkey % 7 when 0 then 'mercadolivre.com.br' when 1 then 'amazon.com.br'
           when 2 then 'shopee.com.br' when 3 then 'americanas.com.br' when 4 then 'magazineluiza.com.br'
           when 5 then 'casasbahia.com.br' else 'loja.com.br' end"""

_INDEX_5 = "lpad(cast(l_orderkey as varchar), cast(greatest(5, length(cast(l_orderkey as varchar))) as int), '0')"

_SKU = f"concat({_SHOP_PREFIX}, '-', 10000 + l_partkey % 90000, '-', {_INDEX_5})"

_URL = f"concat('https://www.', {_SHOP_DOMAIN}, '/produto/', replace(lower({_SKU}), '-', '/'))"

_WORDS = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

_INDEX = f"""
indice as (
  select coluna, token, id_produto, count(*) as ocorrencias from (
    select 'descricao' as coluna, unnest({_WORDS.format("descricao")}) as token, id_produto from coleta
    union all
    select 'marca', unnest({_WORDS.format("marca")}), id_produto from coleta
  ) group by all
)"""

_PAIRS = """
pares as (
  select distinct cod_informante, id_produto from coleta where cod_informante is not null
),
postos as (
  select *, row_number() over (order by md5(cod_informante || '|' || id_produto), cod_informante, id_produto) as posicao,
         count(*) over () as n
  from pares
)"""

_HEX = "cast('0x' || substr(md5({}), 1, {}) as bigint)"

_TOTAL = f"select count(*) as cnt from enriquecida where {SINCE_TERM}"

ORACLES: dict[str, str] = {
    # sources and the enriched view
    "scan_collection": _fact(
        "select * exclude (numero, codigos), array_to_string(codigos, ',') as codigos, "
        "cast(len(codigos) as int) as n_codigos from coleta"
    ),
    "scan_flat": _fact("select * exclude (numero, codigos) from coleta"),
    "scan_registry": f"with {CADASTRO} select * from cadastro",
    "enriched_base": _rows("true"),
    "parse_collection_date": _fact(
        """, textos as (select id_coleta, id_imagem,
             case numero % 13 when 0 then 'xx' when 1 then '' when 2 then null else data_coleta end as texto from coleta)
           select *, strftime(try_cast(texto as date), '%d/%m/%Y') as data from textos"""
    ),
    # filters
    "filter_supplier_code": _rows("cod_informante = '5'"),
    "filter_supplier_name": _rows("nome_informante = 'Supplier#000000005'"),
    "filter_brand": _rows("marca = 'Brand#1'"),
    "filter_price_type": _rows("tipo_preco = '1-URGENT'"),
    "filter_state": _rows("uf = 'NATION_7'"),
    "filter_date_from": _rows("data_coleta >= '1998-01-01'"),
    "filter_description": _rows("lower(descricao) like lower('%RING%')"),
    "filter_all": _rows(f"marca = 'Brand#1' and {SINCE_TERM}"),
    "filter_ean_sku": _view(
        f"select {VISIBLE} from enriquecida where ean = '0000000000016' or sku = '0000000000016' "
        f"union all select {VISIBLE} from enriquecida where ean = 'SKU-16-6' or sku = 'SKU-16-6'"
    ),
    # counts, pages, facets
    "count_filtered": _view(_TOTAL),
    "page_count": _view(
        f"select cnt, cast(greatest(1, ceil(cnt / 30)) as bigint) as paginas from ({_TOTAL})"
    ),
    "page_topk": _ranks("true", "_rn > 30 and _rn <= 60"),
    "page_row_number": _ranks("true", "_rn > 30 and _rn <= 60"),
    "page_deep": _ranks("true", _part_of_the_way(5, 6)),
    "page_deep_by_rank": _ranks("true", _part_of_the_way(1, 2)),
    "count_and_page": _ranks(SINCE_TERM, "_rn > 30 and _rn <= 60").replace(f") select {VISIBLE} from ordenada", f") select {VISIBLE}, _n as cnt from ordenada"),
    "page_after": _ranks("true", "_rn > 60 and _rn <= 90"),
    "page_before": _ranks("true", "_rn <= 30"),
    "page_first": _ranks(SINCE_TERM, "_rn <= 30"),
    "facet_values": _fact(
        " union all ".join(
            f"select distinct '{c}' as faceta, {c} as valor from coleta where {c} is not null"
            for c in ("nome_informante", "marca", "tipo_preco", "uf")
        )
        + " order by faceta, valor"
    ),
    "facet_options": _fact(
        " union all ".join(
            f"select distinct '{c}' as faceta, {c} as valor from coleta where {c} is not null"
            for c in ("nome_informante", "marca", "tipo_preco", "uf")
        )
        + """ union all select distinct 'cod_informante', cod_informante from coleta where codigos is not null
              union all select 'data_min', min(data_coleta) from coleta
              union all select 'data_max', max(data_coleta) from coleta"""
    ),
    "facet_supplier_code": _fact(
        "select distinct cod_informante from coleta where codigos is not null order by cod_informante nulls last"
    ),
    "facet_date_bounds": _fact("select min(data_coleta) as data_min, max(data_coleta) as data_max from coleta"),
    "distinct_products": _fact("select distinct id_produto, descricao, marca from coleta"),
    # selection
    "all_filtered_ids": _view(f"select id_produto from enriquecida where {SINCE_TERM}"),
    "selection_select_all": _view(
        f"select id_produto from coleta where {_SELECTED} union "
        f"select id_produto from enriquecida where marca = 'Brand#1' and {SINCE_TERM}"
    ),
    "selection_reconcile": _view(f"{_PAGE} {_RECONCILED}"),
    "selection_deselected": _view(f"{_PAGE} select distinct id_produto from pagina where id_produto not in (select id_produto from pagina where numero % 2 = 0)"),
    "selection_changed": _view(
        f"""{_PAGE}, depois as ({_RECONCILED})
        select count(*) > 0 as mudou from (
          (select id_produto from depois except select id_produto from escolhidos) union all
          (select id_produto from escolhidos except select id_produto from depois))"""
    ),
    "selection_all_flag": _view(
        f"""{_PAGE}, t as (select count(*) as total from enriquecida where marca = 'Brand#1'),
        f as (select count(*) as faltam from (select distinct id_produto from enriquecida where marca = 'Brand#1')
              where id_produto not in (select id_produto from escolhidos)),
        s as (select count(*) as selecionados from escolhidos)
        select total, selecionados, total > 0 and selecionados >= total as todos,
               total > 0 and faltam = 0 as todos_exato from t, f, s"""
    ),
    "count_selected": _fact(f"select count(distinct id_produto) as selecionados from coleta where {_SELECTED}"),
    "selection_clear": _view(
        f"""select case when count(*) filter (where marca = 'Brand#1' and {SINCE_TERM}) between 1 and count(distinct id_produto)
                   then 0 else count(distinct id_produto) end as selecionados from enriquecida
        union all
        select case when count(*) filter (where marca = 'Brand#1' and {SINCE_TERM})
                         between 1 and count(distinct id_produto) filter (where {_SELECTED})
                   then 0 else count(distinct id_produto) filter (where {_SELECTED}) end from enriquecida"""
    ),
    "mark_selected": _view(f"select {VISIBLE}, {_SELECTED} as selecionado from enriquecida"),
    "rows_by_ids": _view(f"select {VISIBLE} from enriquecida where {_FOUND} order by {ORDEM}"),
    # export and publishing
    "export_formatted": _view(
        f"select {', '.join(_exported(c) for c in VISIBLE_COLUMNS)} from enriquecida where {_FOUND} order by {ORDEM}"
    ),
    "export_workbook": _view(
        f"select {VISIBLE}, row_number() over (order by {ORDEM}) as posicao from enriquecida where {_FOUND}"
    ),
    "export_widths": _view(_WIDTHS),
    "export_labels": _view(_FILLED),
    # stored tables
    "stored_filter": _rows(f"marca = 'Brand#1' and {SINCE_TERM}"),
    "stored_enriched": _rows("true"),
    "stored_filter_files": _rows(f"uf = 'NATION_7' and {SINCE_TERM}"),
    "count_filtered_stored": _view(
        """select cast(0 as int) as filtro, count(*) as cnt from enriquecida where uf = 'NATION_7' and data_coleta >= '1998-01-01'
        union all select 1, count(*) from enriquecida where marca = 'Brand#1' and tipo_preco = '1-URGENT'
        union all select 2, count(*) from enriquecida where cod_informante = '5'
        union all select 3, count(*) from enriquecida"""
    ),
    "stored_page_deep": _ranks("true", _part_of_the_way(5, 6)),
    "stored_page_refreshed": _ranks("true", _part_of_the_way(1, 3)),
    "stored_description_search": _rows("lower(descricao) like lower('%RING%')"),
    "stored_search_extended": _rows("lower(descricao) like '%ring%brand_1%'"),
    "append_rows": _fact(
        f"select count(*) as primeira, count(*) as segunda, 2 * count(*) as lidas from coleta where marca = 'Brand#1' and {SINCE_TERM}"
    ),
    "insert_from_select": _fact("select distinct cod_informante, nome_informante from coleta"),
    # SQL over the views
    "sql_bound_values": _view(
        f"select {VISIBLE}, 'd''água; 100%' as nota from enriquecida where marca = 'Brand#1' and data_coleta >= '1998-01-01'"
    ),
    "sql_subquery": _view(
        "select cod_insumo is not null as codificado, count(*) as linhas from enriquecida where uf = 'NATION_7' group by all"
    ),
    "empty_relation": _rows(f"marca = 'Brand#1' and {SINCE_TERM}"),
    "publish_enriched": _view(f"select {VISIBLE}, substr(data_coleta, 1, 7) as mes_coleta from enriquecida"),
    # registry and keyed maintenance
    "coverage_registry": f"with {CADASTRO} select {_CLASS} as classe, count(*) as linhas from cadastro group by all",
    "coverage_enriched": _view(f"select {_CLASS} as classe, count(*) as linhas from enriquecida group by all"),
    "registry_roster": _roster("select * from roster order by tipo, nome"),
    "registry_display": _roster(
        """select id, nome, coalesce(nullif(email, ''), '—') as email,
                  case tipo when 'master' then 'Master' when 'administrador' then 'Administrador'
                       when 'tecnico' then 'Técnico' else upper(tipo[1]) || lower(tipo[2:]) end as tipo,
                  coalesce(nullif(area, ''), '—') as area from roster"""
    ),
    "registry_lookup_active": _roster("select * from roster where nome = 'Customer#000000042' and ativo = 1"),
    "registry_exists": _roster(
        """select count(*) > 0 as existe from roster where nome = 'Customer#000000042' and ativo = 1
           union all select count(*) > 0 from roster where nome = 'Customer#000000042?' and ativo = 1"""
    ),
    "registry_first": _roster("select * from roster order by tipo, nome limit 1"),
    "registry_insert_new": _roster(
        """select * from roster union all
           select id, nome, email, tipo, area, 1 from vistos where motivo is null""",
        INSERT_BATCH,
    ),
    "registry_rejects": _roster(
        "select id, nome, motivo from vistos where motivo is not null", INSERT_BATCH
    ),
    "registry_delete_protected": _roster(
        "select * from roster where tipo = 'master' or id not in (select id from pedidos)", DELETE_BATCH
    ),
    "registry_delete_outcomes": _roster(
        """select p.id, case when r.id is null then 'nao_encontrado' when r.tipo = 'master' then 'protegido'
                  else 'removido' end as resultado from pedidos p left join roster r on r.id = p.id""",
        DELETE_BATCH,
    ),
    "registry_update_keyed": _roster(
        """select r.id, r.nome, case when r.ativo = 1 then f.email else r.email end as email, r.tipo,
                  case when r.ativo = 1 then f.area else r.area end as area, r.ativo
           from roster r left join finais f on f.id = r.id""",
        UPDATE_BATCH,
    ),
    "registry_merge_stored": _roster(
        """select r.id, r.nome, case when r.ativo = 1 then f.email else r.email end as email, r.tipo,
                  case when r.ativo = 1 then f.area else r.area end as area, r.ativo
           from roster r left join finais f on f.id = r.id
           where r.tipo = 'master' or r.id not in (select id from pedidos)
           union all select id, nome, email, tipo, area, 1 from vistos where motivo is null""",
        INSERT_BATCH,
        UPDATE_BATCH,
        DELETE_BATCH,
    ),
    "registry_update_outcomes": _roster(
        """select m.id, case when count(r.id) = 0 then 'nao_encontrado' else 'alterado' end as resultado
           from mudancas m left join roster r on r.id = m.id and r.ativo = 1 group by m.id""",
        UPDATE_BATCH,
    ),
    "registry_constraint_audit": _roster(
        """, todos as (select id, nullif(trim(nome), '') as nome, nullif(trim(email), '') as email, tipo, ativo from roster
             union all select id, nullif(trim(nome), ''), nullif(trim(email), ''), tipo, 1 from novos)
        select 'nome_obrigatorio' as regra, count(*) as violacoes from todos where nome is null
        union all select 'id_obrigatorio', count(*) from todos where id is null
        union all select 'area_curto', (select count(*) from (select area from roster union all select area from novos) where length(nullif(trim(area), '')) < 7)
        union all select 'id_unico', count(*) from (select id from todos group by id having count(*) > 1)
        union all select 'tipo_obrigatorio', count(*) from todos where tipo is null
        union all select 'tipo_invalido', count(*) from todos where tipo not in ('master', 'administrador', 'tecnico')
        union all select 'email_obrigatorio', count(*) from todos where tipo in ('administrador', 'tecnico') and email is null
        union all select 'ativo_obrigatorio', count(*) from todos where ativo is null
        union all select 'nome_unico', count(*) from (select nome from todos where nome is not null group by nome having count(*) > 1)""",
        INSERT_BATCH,
    ),
    "registry_add_column": _roster(
        "select id, nome, email, tipo, cast(null as varchar) as area, cast(1 as int) as ativo from roster"
    ),
    # derivations
    "derive_sku": f"select l_orderkey, l_linenumber, {_SKU} as sku from lineitem",
    "derive_url": f"select l_orderkey, l_linenumber, {_URL} as url from lineitem",
    "derive_description": "select p_partkey, concat_ws(' ', p_name, p_brand, p_size) as descricao from part",
    "derive_promo_price": """select l_orderkey, l_linenumber, l_extendedprice as preco,
        case when (l_orderkey + l_linenumber) % 10 < 3 then cast(round(
          cast(l_extendedprice as decimal(18,2)) * cast(0.01 * (70 + l_partkey % 26) as decimal(3,2)), 2) as double)
        end as preco_promocional from lineitem""",
    "derive_ids": """select
        concat('PROD', lpad(cast(l_partkey as varchar), cast(greatest(6, length(cast(l_partkey as varchar))) as int), '0')) as id_produto,
        concat('COL', 1000 + l_orderkey % 9000) as id_coleta,
        concat('IMG', 10000 + l_orderkey % 90000) as id_imagem from lineitem""",
    "derive_collection_date": """select l_orderkey, l_linenumber,
        strftime(date '2024-05-01' + cast(l_orderkey % 731 as int), '%Y-%m-%d') as data_coleta from lineitem""",
    "split_proportional": _fact(
        f""", {_PAIRS} select cod_informante, id_produto, posicao,
        case when posicao <= floor(n * 0.40::double) then 'ambos'
             when posicao <= floor(n * 0.70::double) then 'so_insumo' else 'nenhum' end as classe from postos"""
    ),
    "product_refs_explode": _fact(
        f""", produtos as (select distinct id_produto, descricao, marca from coleta),
        copias as (select *, unnest(range(1, 2 + {_HEX.format("id_produto", 4)} % 3)) as ordem from produtos)
        select id_produto, cast(ordem as int) as ordem,
               concat('BP', 100000 + {_HEX.format("id_produto || '-' || ordem", 8)} % 900000) as cod_bp,
               descricao, marca from copias"""
    ),
    # text index
    "text_index_build": _fact(f", {_INDEX} select * from indice"),
    "text_index_lookup": _fact(
        f""", {_INDEX} select id_produto from indice where token in ('small', 'ring')
        group by id_produto having count(distinct token) = 2"""
    ),
}

# Other ways to the same results: selections as bitmaps, options kept by changes, the clustered table.
for _name in ("select_all", "reconcile", "deselected", "changed", "all_flag"):
    ORACLES[f"selection_{_name}_bitmap"] = ORACLES[f"selection_{_name}"]
ORACLES["stored_options"] = ORACLES["stored_options_changed"] = ORACLES["facet_options"]
ORACLES["stored_clustered_filter"] = ORACLES["filter_state"]
ORACLES["rows_by_bitmap"] = ORACLES["rows_by_ids"]
ORACLES["stored_index_lookup"] = ORACLES["stored_index_rows"] = ORACLES["text_index_lookup"]
