"""Row-local calls hold a few observations at a time as Python objects, however many a batch has."""

from pyspark.sql import functions as F

from veilwright.schemas import REGION_FIELDS
from veilwright.sources import ocr, pages


def test_parsed_pages_are_handed_on_in_parts(spark):
    class Row(dict):
        alive = 0

        def __init__(self, **fields):
            super().__init__(**fields)
            Row.alive += 1

        def __del__(self):
            Row.alive -= 1

    def parse(html):
        row = Row(region_index=0, element_id=None, text=None, bbox=None, words=[], visible=True, in_viewport=True)
        row["text"] = f"{len(html)} {Row.alive}"
        return [row]

    rows = spark.range(600, numPartitions=1).select("id", F.expr("repeat('x', 10000)").alias("html"))
    got = pages._exploded(rows, "id", "html", REGION_FIELDS, parse).select("observation_id", "text").collect()
    assert sorted(int(r.observation_id) for r in got) == list(range(600))
    assert all(r.text.split()[0] == "10000" for r in got)
    assert max(int(r.text.split()[1]) for r in got) <= 60


def test_page_regions_with_empty_pages_and_no_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a b</p><p>c</p>")], "page_id int, html string")
    got = pages.page_regions(rows).select("observation_id", "region_index", "text").collect()
    assert sorted(map(tuple, got)) == [("3", 0, "a b"), ("3", 1, "c")]
    assert pages.page_regions(rows.where("page_id > 3")).count() == 0


def test_words_of_few_observations_are_held(spark):
    def probe(words, config):
        import gc

        alive = sum(type(o) is dict and "bbox" in o and "confidence" in o for o in gc.get_objects())
        return [{"text": f"{alive}", "bbox": words[0]["bbox"], "words": words}]

    box = F.expr("named_struct('x', cast(id % 400 as double), 'y', 0D, 'width', 5D, 'height', 16D)")
    words = spark.range(48_000).select(F.expr("cast(id div 400 as string)").alias("observation_id"), F.expr("cast(id as int)").alias("ord"), F.lit("w").alias("text"), F.lit(0.9).alias("confidence"), box.alias("bbox"))
    got = ocr.word_lines(words, builder=probe).select("observation_id", "text", F.size("words").alias("n"), F.expr("transform(words, x -> x.bbox.x)").alias("x")).collect()
    assert sorted(int(r.observation_id) for r in got) == list(range(120))
    assert all(r.n == 400 and r.x == [float(k) for k in range(400)] for r in got)
    assert max(int(r.text) for r in got) < 24_000


def test_lines_of_null_and_blank_observations(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    at = (0.0, 0.0, 5.0, 16.0)
    rows = [(None, 2, "b", 0.9, (9.0, 0.0, 5.0, 16.0)), (None, 1, "a", 0.9, at), ("k", 1, "  ", 0.9, at), ("l", 1, "c", None, at), ("m", 1, "d", 0.9, None)]
    words = spark.createDataFrame(rows, f"observation_id string, ord int, text string, confidence double, bbox {box}")
    got = ocr.word_lines(words).select("observation_id", "line_ord", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, "a b"), ("l", 0, "c")], key=str)
