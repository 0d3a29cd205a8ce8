"""The pipeline on planted cases, and the registered queries on the driver's smallest tables."""

import hashlib
import os
import random

import pytest

DATA = os.environ.get("SEQMESH_TABLES", "/root/testdata/sf0.001")
COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"],
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10": ["doc_id", "item_id", "lcs_share", "cosine", "answer_found"],
    "op11": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(12)
    part = ["ba", "ce", "di", "fol", "gu", "har", "jil", "ko", "lum", "ne"]
    word = lambda: "".join(r.choice(part) for _ in range(r.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30) + ".") for k in range(8)]
    docs, labels = {}, []
    for i in range(500):
        docs[i] = text(r.randint(80, 160))
        if i % 5 == 0:
            words = docs[i].split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["gruzzle", "snorf", "blark"]))
            docs[i] = " ".join(words)
        labels.append((i, 1, int(i % 5 == 0)))
    kinds = {"copy": [], "near": [], "leak": []}
    for k in range(20):
        i = 5 * k + 1
        docs[1000 + k] = docs[i].upper()
        kinds["copy"].append((i, 1000 + k))
        j = 5 * k + 2
        docs[j] = docs[2000 + k] = docs[j] + " " + text(900)
        docs[2000 + k] += " twist"
        kinds["near"].append((j, 2000 + k))
        docs[3000 + k] = text(40) + " " + items[k % 8][1] + " " + text(40)
        kinds["leak"].append(3000 + k)
    docs[4000], docs[4001] = "", None
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, kinds


def test_stages_and_rows(spark, planted):
    import corpus_pipeline as cp
    from seqmesh.session import materialise, table

    folder, docs, kinds = planted
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_encode_decode"]
    now, kept = table(spark, folder, "documents"), []
    for name, stage in cp.STAGES:
        columns = now.columns
        now = materialise(stage(spark, now, folder), name)
        if name != "bpe_encode_decode":
            assert now.columns == columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    toxic, exact, near, clean, coded = kept
    wrong = {i for i in range(500) if (i % 5 == 0) == (i in toxic)}
    assert len(wrong) <= 5 and all(i in toxic for i in docs if i >= 1000)
    assert exact == toxic - {a for a, b in kinds["copy"] if b in toxic} - {4000}
    gone = exact - near
    assert {b for a, b in kinds["near"] if a in exact} <= gone and gone <= {b for _, b in kinds["near"]}
    assert near - clean == set(kinds["leak"]) & near
    assert coded == clean
    final = {r.doc_id: r for r in now.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((docs[i] or "").encode()).hexdigest() for i, r in final.items())
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, final.values()))


def test_empty_documents(spark, planted, tmp_path):
    import corpus_pipeline as cp
    from seqmesh.session import table

    folder, _, _ = planted
    for name in ("labels", "benchmark"):
        table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_names_and_oracles():
    from seqmesh.llm.queries import ORACLES, QUERIES

    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("number", range(1, 14))
def test_registered_query(spark, number):
    import duckdb

    from seqmesh.llm.queries import ORACLES, QUERIES

    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    got = QUERIES[name](spark, DATA)
    assert got.columns == COLUMNS[f"op{number}"]
    rows = got.collect()
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    if number != 10:
        assert len(rows) == con.sql(f"SELECT count(*) FROM {'pages' if number == 1 else 'documents'}").fetchall()[0][0]
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        order = [want.columns.index(c) for c in got.columns]
        assert sorted((tuple(r) for r in rows), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
