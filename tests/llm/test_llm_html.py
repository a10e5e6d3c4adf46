"""Links of hostile pages: patterns without an end cost time in proportion to the page, and change nothing that is found."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import url_filters

BITS = ["<!--", "-->", "<script>", "</script >", "<STYLE x>", "</style>", "<link rel=canonical href='/a'>", "<meta http-equiv=refresh content='0;url=/b'>", ">", "<", "<link ", "x", '"', "'", " \n", "<!-->", "<scriptx>", "--", "é"]


def tags(html, name):
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1)


def test_plain_html_keeps_what_the_patterns_keep(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("".join(rng.choice(BITS) for _ in range(rng.randrange(25))),) for _ in range(5000)], "h string")
    direct = F.regexp_replace("h", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    both = df.select(*[tags(x, n).alias(f"{n}{k}") for n in ("link", "meta") for k, x in enumerate((direct, url_filters.plain_html(F.col("h"))))])
    assert both.where("link0 <> link1 or meta0 <> meta1").count() == 0 and both.where("size(link0) > 0").count() > 1000
    assert spark.range(1).select(url_filters.plain_html(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("unit", ["<link ", "<!-- ", "<script ", "<style>a", '<link rel="', "<link rel='", "</script ", "<link rel ", '<meta http-equiv=refresh content="url="', "<link <!-- <script >", "-->"])
def test_hostile_pages_take_linear_time(spark, unit):
    page = spark.createDataFrame([(1, "http://a.io/x", unit)], "page_id long, url string, html string").withColumn("html", F.repeat("html", 2_000_000 // len(unit)))
    began = time.time()
    assert page.select(F.size(url_filters.link_targets(F.col("url"), F.col("html")))).first()[0] == 0
    assert time.time() - began < 20
