import os

import pytest

from fondaco.llm import queries
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]
        return kept[name]

    return of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""


def test_consensus_of_items_that_are_voted_differently(spark, rows):
    all_items = {r["massima_id"]: r for r in rows("p1_consensus")}
    found = rows("p1_found")
    assert {r["massima_id"] for r in found} < set(all_items) and len(found) == len({r["massima_id"] for r in found})
    assert all(all_items[r["massima_id"]]["label"] == r["label"] and all_items[r["massima_id"]]["agreement"] < 1 for r in found)
    assert all(0 <= r["agreement"] <= 1 and 0 < r["confidence"] <= 1 for r in all_items.values())
    models = rows("p1_models")
    assert len(models) == len({r["model"] for r in models}) > 1 and all(0 < r["competence"] < 1 for r in models)


def test_groups_are_the_components_of_the_pairs(spark, rows):
    group = {r["id"]: r["group_id"] for r in rows("p2_groups")}
    parent = {i: i for i in group}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows("p2_found"):
        parent[max(root(r["id_a"]), root(r["id_b"]))] = min(root(r["id_a"]), root(r["id_b"]))
    assert group == {i: root(i) for i in group}


def test_repairs_hold_the_words_that_were_found(spark, rows):
    texts = {r["id"]: r["text"].lower() for r in rows("p4_texts")}
    words = [r for r in rows("p4_found") if r["kind"] == "parola"]
    assert len(words) > 50 and sum(r["item"] in texts[r["id"]] for r in words) >= 0.98 * len(words)
    lines = [r for r in rows("p4_found") if r["kind"] == "riga"]
    assert len(lines) > 5 and not any("\n" in t for t in texts.values())


def test_matches_and_their_confidence(spark, rows):
    found = {r["altalex_id"]: r["normativa_id"] for r in rows("p5_found")}
    sure = {r["altalex_id"]: r for r in rows("p5_confidence")}
    assert {i: r["brocardi_match_id"] for i, r in sure.items()} == found and all(0.5 <= r["brocardi_similarity"] <= 1 for r in sure.values())
    earlier = spark.read.parquet(f"{SF}/normativa_altalex.parquet").where("brocardi_match_status in ('exact', 'format_diff')").select("id", "brocardi_match_id").collect()
    assert all(found.get(r["id"]) == r["brocardi_match_id"] for r in earlier)


def test_every_document_is_encoded_and_packed(spark, rows):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {r["doc_id"]: r["ids"] for r in rows("p8_ids")}
    assert set(ids) == set(documents) and all(bool(ids[i]) == bool(t) for i, t in documents.items())
    packed: dict = {}
    for r in rows("p9_containers"):
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == {i: len(x) for i, x in ids.items()}
    assert rows("p9_fill")[0]["containers"] <= -(-sum(packed.values()) // 4096) + 1


def test_kinds_of_residue_are_those_found(spark, rows):
    kinds = {r["doc_id"]: r["kinds"] for r in rows("p10_kinds")}
    assert set(kinds) == {r["doc_id"] for r in rows("p10_found")} and all(set(k.split(",")) <= {"error", "script", "placeholder", "filler"} for k in kinds.values())
