import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
from quern.llm import langid, quality, sentencepiece_codec, simhash, toxicity, html_text
df = spark.createDataFrame([(k, f"some words {{k}} here", "en", "s", k % 2, "<p>x</p>") for k in range(8)], "doc_id long, text string, lang string, source string, toxic int, html string")
langid.predict(df, langid.train(df)).collect()
sentencepiece_codec.decode(sentencepiece_codec.encode(df, sentencepiece_codec.vocabulary()), sentencepiece_codec.vocabulary()).collect()
toxicity.predict(df, toxicity.train(df, df.select("doc_id", "toxic"))).collect()
quality.score(df.withColumnsRenamed({{"source": "host", "lang": "path"}}), quality.train(df, df.select("doc_id", df.toxic.alias("quality")))).collect()
simhash.near_duplicates(df).collect()
html_text.extract(df.drop("text"), model=html_text.Labeller(4, 1)).collect()
print("fine")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
