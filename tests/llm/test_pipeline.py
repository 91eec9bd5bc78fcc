import corpus_pipeline
from test_minhash import brute
from test_packing import FILE
from test_substrings import repeats
from tokenizers import Tokenizer

from facetide.session import stored


def test_stages_over_given_documents(spark, folder):
    """Each stage against a plain version of its rule, and the whole against a second run."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    counts = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys() and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near_dedup":
            assert after == {i: before[i] for i, _, _, kept in brute(before.items(), 5, 80) if kept}
        elif name == "substring_dedup":
            again = repeats(before.items())
            assert after.keys() == before.keys()
            assert all(len(after[i].split()) <= len(before[i].split()) - 46 for i in again)
            assert not [i for i in repeats(after.items()) if i not in again]
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert not [i for i, t in after.items() if any(x in t for x in items)]
        counts.append(len(after))
        before = after
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = Tokenizer.from_file(FILE)
    assert sum(r.length for r in packed) == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
