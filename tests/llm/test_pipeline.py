"""The pipeline's stages against brute force on the smallest tables."""

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import brute


def test_stages(spark, small):
    import corpus_pipeline as pipeline
    from partloom.llm.shared import stored, table

    docs = table(spark, small, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, small), "test-stage")
        after = docs.collect()
        if n < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept = {r.doc_id for r in after}
        assert kept <= set(before)
        if n == 1:
            sets = {i: brute.shingles(t) for i, t in before.items()}
            alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            assert all(any(alike(i, j) for j in before if j != i) for i in set(before) - kept)
            texts = [before[i].lower().split() for i in kept]
            assert len({tuple(t) for t in texts}) == len(texts)
        if n == 2:
            items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
            assert kept == {w[0] for w in brute.contaminated(list(before.items()), items) if not w[5]}
        if n == 3:
            words = sum(len(brute.RUN.findall(t)) for t in before.values())
            assert sum(len(brute.RUN.findall(r.text)) for r in after) == int(1.5 * words)
            mixed = sorted((r.doc_id, r.text) for r in after)
        if n == 4:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in mixed)
            assert sorted((r.doc_id, r.n_tokens) for r in after) == want
