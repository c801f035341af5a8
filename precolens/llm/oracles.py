"""DuckDB SQL for the queries that SQL can express."""

import hashlib
from itertools import cycle


def _owners(names: list[str], size: int) -> list[str]:
    """The sharding table, filled from written-out orders of preference."""

    def number(text: str) -> int:
        return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big") >> 4

    wishes = {}
    for name in names:
        first, step = number("offset " + name) % size, number("skip " + name) % (size - 1) + 1
        wishes[name] = iter([(first + k * step) % size for k in range(size)])
    owners: dict[int, str] = {}
    for name in cycle(names):
        if len(owners) == size:
            return [owners[i] for i in range(size)]
        owners[next(slot for slot in wishes[name] if slot not in owners)] = name


_OWNERS = ", ".join(f"'{name}'" for name in _owners([f"shard-{i:02d}" for i in range(32)], 4099))

def _terms(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES: dict[str, str] = {
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, body, strlen(body) as n, max(page_id) over (partition by body) as top from p)
        select page_id, n as payload_bytes, sha1(body) as payload_digest,
               case when n >= 1000 and top > page_id then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and top > page_id then top end as refers_to, true as digest_ok
        from d
    """,
    "op5_topk": """
        with e as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ),
        s as (
            select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score
            from e q join e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
               vec_id, score
        from s qualify rank <= 10
    """,
    "op7_sharding": f"""
        with s as (
            select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % 4099 as slot
            from documents
        )
        select doc_id, slot, ([{_OWNERS}])[slot + 1] as shard from s
    """,
    "op12_lexical": f"""
        with d as (select doc_id, row_number() over () as row, {_terms("text")} as terms from documents),
        s as (select count(*) filter (len(terms) > 0) as docs, sum(len(terms)) as length from d),
        tf as (select row, term, count(*) as tf from (select row, unnest(terms) as term from d) group by all),
        w as (
            select term, cast(floor(1000 * ln((2 * any_value(s.docs) + 2) / (2 * count(*) + 1))) as bigint) as w
            from tf, s group by term
        ),
        part as (
            select tf.row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * docs) // length))) as part
            from tf join w using (term) join d using (row), s
        ),
        q as (select item_id, unnest({_terms("text")}) as term from benchmark),
        scores as (
            select item_id, row, cast(sum(part) as bigint) as score from q join part using (term) group by all
        )
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
               doc_id, score
        from scores join d using (row) where score > 0 qualify rank <= 10
    """,
}
