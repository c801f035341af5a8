"""Change sets against a row-by-row replay, the audit, coverage and the proportional split."""

import math
import random

import pytest

from precolens.operators import maintenance, split
from precolens.schemas import ROSTER

BATCH = "seq long, id long, nome string, email string, tipo string, area string"


@pytest.fixture
def roster(spark):
    return spark.createDataFrame(
        [
            (1, "Master", None, "master", None, 1),
            (2, "Ana", "ana@x", "tecnico", "sul", 1),
            (3, "Bia", "bia@x", "administrador", None, 0),
        ],
        ROSTER,
    )


def clean(text):
    return (text or "").strip() or None


def replay(existing, batch, ids=()):
    """The batch one row after the other: names first, then ids."""
    names, taken, valid, accepted, rejected = set(existing), set(ids), [], [], []
    for seq, key, name, email, kind, area in sorted(batch, key=lambda r: r[0]):
        name, email, area = clean(name), clean(email), clean(area)
        if not name:
            rejected.append((key, name, "nome_obrigatorio"))
        elif kind in ("administrador", "tecnico") and not email:
            rejected.append((key, name, "email_obrigatorio"))
        elif kind not in ("master", "administrador", "tecnico"):
            rejected.append((key, name, "tipo_invalido"))
        elif name in names:
            rejected.append((key, name, "ja_existe"))
        else:
            names.add(name)
            valid.append((key, name, email, kind, area, 1))
    for row in valid:
        if row[0] in taken:
            rejected.append((row[0], row[1], "id_em_uso"))
        else:
            taken.add(row[0])
            accepted.append(row)
    return accepted, rejected


@pytest.mark.parametrize("seed", range(3))
def test_insert_equals_replay(spark, roster, seed):
    rnd = random.Random(seed)
    batch = [
        (
            i,
            rnd.choice([100 + i, 2, 200 + i % 3]),
            rnd.choice(["Ana", " Ana\t", "Caio", "Caio ", "Duda", "Eva", "", "  ", None, f"N{i}", f"M{i}"]),
            rnd.choice(["x@y", "", None, " z "]),
            rnd.choice(["tecnico", "administrador", "master", "outro", None]),
            rnd.choice(["norte", " ", None]),
        )
        for i in range(40)
    ]
    accepted, rejected = replay(["Master", "Ana", "Bia"], batch, [1, 2, 3])
    changes = spark.createDataFrame(batch, BATCH)
    after = [tuple(r) for r in maintenance.insert_new(roster, changes).collect()]
    assert sorted(after) == sorted([tuple(r) for r in roster.collect()] + accepted)
    got = [tuple(r) for r in maintenance.insert_rejects(roster, changes).collect()]
    assert sorted(got, key=str) == sorted(rejected, key=str)


def test_delete_keeps_protected_rows(spark, roster):
    keys = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id long")
    assert {r.id for r in maintenance.delete_keys(roster, keys).collect()} == {1, 3}
    outcomes = {r.id: r.resultado for r in maintenance.delete_outcomes(roster, keys).collect()}
    assert outcomes == {1: "protegido", 2: "removido", 9: "nao_encontrado"}


@pytest.mark.parametrize("seed", range(4))
def test_updates_equal_replay(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"N{i}", rnd.choice(["a@x", None]), "tecnico", rnd.choice(["sul", None]), i % 3 and 1) for i in range(12)]
    batch = [(s, rnd.randrange(15), rnd.choice([f"e{s}@x", None]), rnd.choice([f"area{s}", None])) for s in range(60)]
    state = {r[0]: list(r) for r in rows}
    outcomes = {}
    for _, key, email, area in batch:
        found = key in state and state[key][5] == 1
        outcomes[key] = "alterado" if found else "nao_encontrado"
        if found:
            state[key][2] = email or state[key][2]
            state[key][4] = area or state[key][4]
    rnd.shuffle(batch)
    roster, changes = spark.createDataFrame(rows, ROSTER), spark.createDataFrame(batch, "seq long, id long, email string, area string")
    after = maintenance.update_keyed(roster, changes, ["email", "area"]).collect()
    assert sorted(map(tuple, after)) == sorted(map(tuple, state.values()))
    assert {r.id: r.resultado for r in maintenance.update_outcomes(roster, changes).collect()} == outcomes


def test_audit(spark):
    rows = spark.createDataFrame(
        [
            (1, "Mariana", None, "master", None, 1),
            (2, "Mariana", " ", "tecnico", None, 1),
            (3, "Ana", "a@x", "outro", None, None),
            (4, " ", "a@x", None, None, 1),
            (5, None, None, "administrador", None, 1),
            (5, "Eva", None, "master", None, 1),
            (None, "Ivo", None, "master", None, 1),
        ],
        "id long, nome string, email string, tipo string, area string, ativo int",
    )
    assert "nome_curto" not in {r.regra for r in maintenance.constraint_audit(rows).collect()}
    found = {r.regra: r.violacoes for r in maintenance.constraint_audit(rows, {"nome": 6}).collect()}
    assert found == {
        "id_obrigatorio": 1,
        "id_unico": 1,
        "nome_obrigatorio": 2,
        "nome_curto": 3,
        "tipo_obrigatorio": 1,
        "tipo_invalido": 1,
        "email_obrigatorio": 2,
        "ativo_obrigatorio": 1,
        "nome_unico": 1,
    }


def test_listing_display_and_lookup(roster):
    assert [r.nome for r in maintenance.listing(roster).collect()] == ["Bia", "Master", "Ana"]
    shown = {r.id: (r.email, r.tipo, r.area) for r in maintenance.display(roster).collect()}
    assert shown[1] == ("—", "Master", "—") and shown[2] == ("ana@x", "Técnico", "sul")
    assert maintenance.exists(maintenance.lookup_active(roster, "Ana"))
    assert not maintenance.exists(maintenance.lookup_active(roster, "Bia"))


def test_coverage_counts_zero_and_blank_as_missing(registry, fact):
    codes = registry(
        (1, "P", "INS", 5), (1, "Q", "INS", 0), (1, "R", "INS", None), (1, "S", "", 5), (1, "T", None, None), (1, "P", "INS", None)
    )
    got = {r.classe: r.linhas for r in maintenance.coverage_registry(codes).collect()}
    assert got == {"ambos": 1, "so_insumo": 3, "nenhum": 2}
    rows = fact(*[{"cod_informante": ["1"], "id_produto": p} for p in "PPQSX"], {"cod_informante": [], "id_produto": "P"})
    got = {r.classe: r.linhas for r in maintenance.coverage_enriched(rows, codes).collect()}
    assert got == {"ambos": 2, "so_insumo": 3, "nenhum": 3}


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_is_exact(spark, n):
    rows = spark.range(n).selectExpr("cast(id % 5 as string) as cod", "cast(id as string) as id").union(
        spark.range(n).selectExpr("cast(id % 5 as string)", "cast(id as string)")
    )
    got = split.split_keys(rows, ["cod", "id"]).collect()
    assert sorted(r.posicao for r in got) == list(range(1, n + 1))
    sizes = [sum(r.classe == c for r in got) for c in ("ambos", "so_insumo", "nenhum")]
    both, any_code = math.floor(n * 0.40), math.floor(n * 0.70)
    assert sizes == [both, any_code - both, n - any_code]


def test_references_per_product(spark):
    products = spark.range(300).selectExpr("concat('PROD', id) as id_produto", "'d' as descricao", "'m' as marca")
    rows = split.product_references(products).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.id_produto, []).append(r.ordem)
        assert r.cod_bp.startswith("BP") and 100000 <= int(r.cod_bp[2:]) <= 999999
    assert len(counts) == 300
    assert {tuple(sorted(v)) for v in counts.values()} == {(1,), (1, 2), (1, 2, 3)}
