from pyspark.sql import functions as F

from postgrain.operators.market import candidate_terms
from postgrain.rules.stopwords import STOPWORDS


def test_common_and_role_words_are_no_terms(spark):
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 350
    rows = spark.createDataFrame([("many able engineers need team experience, kafka skills required",)], "text string")
    assert rows.select(F.explode(candidate_terms("text")).alias("t")).collect() == [("kafka",)]
