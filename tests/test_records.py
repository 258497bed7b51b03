"""Result records to and from JSON."""

from wadi.sources import records as R

SCHEMA = "key string, unit int, word int, heard string, rate double, tags array<string>, confidence map<string,double>"


def test_round_trip(spark):
    rows = [("a", 1, 2, 'x "y"\n', 0.5, ["p", "q"], {"m": 0.25}), ("a", 1, 1, None, None, [], None), ("a", 2, 1, "بَ", 1.0, None, {}), (None, None, 1, "z", 0.0, ["r"], {"n": 1.0})]
    df = spark.createDataFrame(rows, SCHEMA)
    made = R.write_records(df, ["key", "unit"], "word")
    schema = R.record_schema(df, ["key", "unit"], "word")
    back = R.read_records(made, schema).select(*df.columns)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key) and back.schema.simpleString() == df.schema.simpleString()
    assert made.count() == 3 and R.read_records(made.limit(0), schema).count() == 0


def test_unknown_missing_and_broken(spark):
    df = spark.createDataFrame([], SCHEMA)
    schema = R.record_schema(df, ["key", "unit"], "word")
    texts = ['{"key":"a","unit":1,"more":3,"items":[{"word":1,"heard":"x","other":[1]}]}', '{"key":"b"}', "{not json", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    got = R.read_records(table, schema).collect()
    assert [(r["key"], r["unit"], r["word"], r["heard"], r["rate"]) for r in got] == [("a", 1, 1, "x", None)]
    flags = {r["i"]: r["bad"] for r in table.select("i", R.broken(table["record"], schema).alias("bad")).collect()}
    assert flags == {0: False, 1: False, 2: True, 3: False}
