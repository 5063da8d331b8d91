import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, decontaminate, simhash


def groups_by_simhash(texts):
    """Ids of texts that reach each other over fingerprints of two differing bits at most, all pairs compared."""
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = {}
    for i in ids:
        out.setdefault(find(i), set()).add(i)
    return list(out.values())


def test_near_dedup_of_the_table_itself(spark):
    """The stage on documents whose lines are still there, where near copies are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    grouped = groups_by_simhash(texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {min(g) for g in grouped} and len(grouped) < len(texts)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with names that stages use inside."""
    folder = "/root/testdata/sf0.001"
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = real + [(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, "a plain text of its own, not like any other one here " * 4000, None, "s", None), (None, "no id here at all", "en", "s", 9), real[0], real[0]]
    rows += [(10**6 + 3, "first of two rows with an id", "en", "s", 1), (10**6 + 3, "second and other row with that id", "en", "s", 1), (10**6 + 4, "\n \t\n", "en", "s", 4)]
    clash = {c: F.lit("old") for c in ("_lang_pred", "_lang_score", "kept", "removed", "block", "component_id", "node", "hashes", "hit_spans", "token_ids", "decoded", "row", "key")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    ids = {r[0] for r in rows if r[0] is not None}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder).collect()
        assert found and {r.doc_id for r in found} <= ids | {None}, name
        assert stage(spark, docs.where("false"), folder).collect() == [], name
        if name == "language ID":
            assert not {10**6, 10**6 + 1, 10**6 + 4, None} & {r.doc_id for r in found} and {10**6 + 2, 10**6 + 3} <= {r.doc_id for r in found}
        if name == "byte-level BPE":
            assert len(found) == len(rows) and all(r.round_trip for r in found)


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes, kept = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        kept = corpus_pipeline.stored(stage(spark, kept, folder), "test")
        rows = kept.collect()
        sizes.append(len(rows))
        assert {r.doc_id for r in rows} <= set(before) and len({r.doc_id for r in rows}) == len(rows)
        if name != "byte-level BPE":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
        if name == "language ID":
            assert all(not any(c.isalpha() for c in before[i] or "") or len(before[i]) < 20 for i in set(before) - {r.doc_id for r in rows})
        if name == "line dedup":
            seen = set()
            for r in sorted(rows, key=lambda r: r.doc_id):
                own = [x.strip() for x in r.text.split("\n") if x.strip()]
                assert own and not seen & set(own) and len(set(own)) == len(own) and r.n_chars == len(r.text)
                seen |= set(own)
        if name == "SimHash near-dedup":
            grouped = groups_by_simhash(before)
            assert {r.doc_id for r in rows} == {min(g) for g in grouped}
        if name == "benchmark decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            finder = decontaminate.WuManber(items)
            assert {i for i, t in before.items() if finder.search(decontaminate.words(t))[0]} == set(before) - {r.doc_id for r in rows}
        if name == "byte-level BPE":
            one = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            assert all(r.round_trip and one.decode(r.token_ids).decode() == before[r.doc_id] for r in rows)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_run_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
