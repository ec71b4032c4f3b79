import random

from pyspark.sql import functions as F

from postgrain.functions.hosts import ascii_host, ascii_label
from postgrain.functions.urls import canonicalize_url, host_of


def applied(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(4)
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_labels_equal_the_codec(spark):
    draw = random.Random(5)
    letters = ["abcxyz019-", "äöüßéñ", "абвгд", "漢字仮名交", "\U00010348\U0001F600\U0002F800", "\u0080߿￯"]
    labels = ["".join(draw.choice(draw.choice(letters[:1 + draw.randrange(6)]))
                      for _ in range(draw.randrange(1, 40))) for _ in range(400)]
    labels += ["ü" * 250, "a" * 200 + "ü", "\U0010ffff", "-ü", "ü-", "--ü--"]
    expected = [t if t.isascii() else "xn--" + t.encode("punycode").decode() for t in labels]
    assert applied(spark, ascii_label, labels) == expected


def test_hosts(spark):
    pairs = {
        "bücher.example": "xn--bcher-kva.example", "example": "example", "": "",
        "bücher.example:8080": "xn--bcher-kva.example:8080", "a.b.c": "a.b.c",
        "例え。テスト": "xn--r8jz45g.xn--zckzah", "a．ü｡b": "a.xn--tda.b",
        "ü.": "xn--tda.", "ü:80": "xn--tda:80",
    }
    assert applied(spark, ascii_host, list(pairs)) == list(pairs.values())
    assert applied(spark, ascii_host, [None]) == [None]


def test_urls_with_international_hosts(spark):
    pairs = {
        "https://BÜCHER.example/a": "https://xn--bcher-kva.example/a",
        "http://www.Bücher.example:80/ü?x=1": "http://xn--bcher-kva.example/%C3%BC?x=1",
        "https://xn--bcher-kva.example/a/": "https://xn--bcher-kva.example/a",
        "https://u@bücher.example:444": "https://xn--bcher-kva.example:444/",
    }
    assert applied(spark, canonicalize_url, list(pairs)) == list(pairs.values())
    assert applied(spark, host_of, ["https://Bücher.example:443/x"]) == ["xn--bcher-kva.example"]


def test_parameters_sort_as_text_is_compared(spark):
    pairs = {
        "https://e.com/?B=1&a=2&A=1&b=1": "https://e.com/?a=2&A=1&b=1&B=1",
        "https://e.com/?z=1&é=1&f=1&e=1": "https://e.com/?e=1&%C3%A9=1&f=1&z=1",
        "https://e.com/?k=b&k=A&k=a&k=B": "https://e.com/?k=a&k=A&k=b&k=B",
        "https://e.com/?a10=1&a2=1&a_b=1&a-b=1": "https://e.com/?a_b=1&a-b=1&a10=1&a2=1",
        "https://e.com/?q=1&q=1": "https://e.com/?q=1&q=1",
    }
    assert applied(spark, canonicalize_url, list(pairs)) == list(pairs.values())
