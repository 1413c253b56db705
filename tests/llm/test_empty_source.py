"""A source without a word has a target of 0 and must not stop the mix."""

from sidforge.llm import mixing


def test_source_of_null_and_empty_texts(spark):
    texts = {"a": "one two three", "b": "four five", "empty": None, "white": " \t\n"}
    rows = [(i, source, text) for source, text in texts.items() for i in range(20)] + [(90, "empty", ""), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sized = docs.select("doc_id", "source", mixing.token_count("text").alias("size"))
    for budget in (mixing.BUDGET, 0.0):
        found = mixing.mix(sized, budget).collect()
        assert len(found) == len(rows)
        for r in found:
            if r.source not in ("a", "b"):
                assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
        taken = {s: sum(r.taken for r in found if r.source == s) for s in "ab"}
        if budget:
            # 150 tokens at weights 3 and 1; documents of 3 and 2 words are not cut.
            assert abs(taken["a"] - 112.5) <= 3 and abs(taken["b"] - 37.5) <= 2 and sum(taken.values()) <= 150
        else:
            assert taken == {"a": 0, "b": 0}
