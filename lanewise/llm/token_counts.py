"""Token counts through a digest cache: every distinct text is encoded once per tokenizer version, ever."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.shared import shared_folder, whole_text

CACHE = "key string, n_tokens long"
#: Texts handed to the library at once; bounds what it holds, not what it counts.
BATCH_BYTES = 4_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another version never match."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as file:
        return hashlib.sha256(library.encode() + b"\0" + file.read()).hexdigest()


_LOADED: dict[str, object] = {}


def counter(path: str):
    """texts -> token counts, with the library of the file's kind; one tokenizer per worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
            _LOADED[path].no_truncation()
            _LOADED[path].no_padding()
    model = _LOADED[path]
    if path.endswith(".model"):
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts, part, size, counts = batch.column("body").to_pylist(), [], 0, []
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    return run


def _cached(spark: SparkSession, cache: str) -> DataFrame:
    """The counts stored so far; none if the folder does not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(CACHE).parquet(cache) if exists else spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``, without begin, end or added special tokens.

    ``tokenizer`` is a vocabulary file every machine has (``.model``: sentencepiece, ``.json``: tokenizers). ``cache`` is a
    folder of earlier counts that this run reads and appends to (a new one in the shared folder if not given). A count's key
    is the digest of the text's digest and the tokenizer version's. Only one row of each text missing from the cache is
    encoded. Texts are taken as they are: any other normal form could change a count. Null texts count as empty (0 tokens).
    Null or repeated doc_ids and repeated rows keep their own output rows. Two runs that append the same key do no harm:
    the cache is read distinct. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cache = cache or shared_folder(spark)
    body = whole_text(text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("key", F.sha2(F.concat(F.lit(tokenizer_version(tokenizer)), F.sha2("body", 256)), 256))
    digests = keyed.select("doc_id", "key", F.octet_length("body").cast("long").alias("n_bytes"))
    # One row of each missing text; digests move here, texts do not.
    todo = digests.groupBy("key").agg(F.min("doc_id").alias("one")).join(_cached(spark, cache).select("key").distinct(), "key", "left_anti")
    todo = todo.withColumnRenamed("key", "miss")
    misses = keyed.join(todo, keyed["doc_id"].eqNullSafe(todo["one"]) & (keyed["key"] == todo["miss"]), "left_semi").select("key", "body")
    misses.mapInArrow(_encode(tokenizer), CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(counts, "key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
