"""What a training leaves in the driver."""

from tallyforge.llm import langid


def test_training_gives_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(langid, "release", lambda: given.append(1), raising=False)
    rows = spark.createDataFrame([(k, "ka lo mi " * 5 if k % 2 else "ung ein ver " * 5, "aa" if k % 2 else "bb") for k in range(20)], "doc_id long, text string, lang string")
    assert langid.train(rows, ["ka", "lo", "mi", "un", "ei", "ve"]).languages == ["aa", "bb"] and given == [1]
