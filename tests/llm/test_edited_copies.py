"""Benchmark items edited word by word: whatever plain alignment over a whole text finds, seeds find as well."""

import numpy as np
from sluicework.llm import decontaminate


def edited(rng, words, share, corpus):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            out.append(str(rng.choice(corpus)))  # replaced
        elif x < 2 * share / 3:
            out += [w, str(rng.choice(corpus))]  # added
        elif x >= share:
            out.append(w)  # else dropped
    return out


def test_edited_copies_are_found(spark, tiny):
    rng = np.random.default_rng(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect() if len(decontaminate.words_of(r.text)) >= 8][:30]
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect() if r.text]
    corpus = [w for t in texts for w in decontaminate.words_of(t)]
    rows, planted = [], []
    for k in range(120):
        item, text = items[k % len(items)]
        copy = edited(rng, decontaminate.words_of(text), rng.uniform(0.1, 0.25), corpus)
        around = [str(w) for w in rng.choice(corpus, 60)]
        rows.append((k, " ".join([*around[:30], *copy, *around[30:]])))
        planted.append((k, item, text))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    wanted = set()
    for k, item, text in planted:
        target, words = decontaminate.words_of(text), decontaminate.words_of(rows[k][1])
        full = decontaminate.align(np.arange(len(target)), np.arange(len(target)))[0]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(target))}
        a = np.array([numbers[w] for w in target])
        b = np.array([numbers.get(w, -1) for w in words])
        if 2 * decontaminate.align(a, b)[0] >= full:
            wanted.add((k, item))
    assert len(wanted) > 100 and wanted <= found
