"""Training of the language model visits every position of every text in each round."""

from docloom.llm import lm


def test_every_position_is_visited(spark, monkeypatch, tmp_path):
    texts = [None, "", "a b c", *["x y z w " * 30] * 20, *(f"t{k} a b" for k in range(40))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain, seen = lm.nce_epoch, str(tmp_path / "seen")

    def counted(params, prior, u, v, w, **named):
        with open(seen, "a") as f:
            f.write(f"{len(w)}\n")
        return plain(params, prior, u, v, w, **named)

    monkeypatch.setattr(lm, "nce_epoch", counted)
    monkeypatch.setattr(lm, "BLOCK", 100)
    lm.train(docs, lm.count_words(docs), vocab=8, hot=16, rounds=2)
    with open(seen) as f:
        visited = sum(map(int, f))
    assert visited == 2 * sum(len((t or "").split()) + 1 for t in texts)
