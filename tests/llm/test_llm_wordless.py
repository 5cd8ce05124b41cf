from collections import Counter

import pytest

from shelfline.llm import mixing


def test_rows_without_words_get_the_rate_of_their_source(llm):
    texts = {"a": "w " * 30, "b": "w " * 10, "c": "w " * 11}
    rows = [(i, texts["abc"[i % 3]] if i < 300 else ["", None, " \t"][i // 3 % 3], "abc"[i % 3]) for i in range(6300)]
    rows += [(7000, "", "none"), (None, None, None)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    counts, rates = Counter(), {}
    for r in found:
        if r["source_size"] == 0:
            assert r["copies"] == 0
            continue
        rates[r["source"]] = r["target"] / r["source_size"]
        if r["size"] == 0:
            assert int(rates[r["source"]]) <= r["copies"] <= int(rates[r["source"]]) + 1
            counts[r["source"]] += r["copies"]
    assert any(rate < 1 for rate in rates.values())
    for source, rate in rates.items():
        assert counts[source] / 2000 == pytest.approx(rate, abs=0.05)
    mixed = mixing.mixed_documents(docs)
    assert mixed.filter("trim(coalesce(text, '')) IN ('', '\t')").count() == sum(counts.values())
