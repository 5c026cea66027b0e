"""Training-data operators: near-duplicates, packing, line and substring dedup, toxicity,
nearest neighbours, sharding, mixing, quality rules and WARC archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Rules that all
operators share:

* null texts count as empty, null keys match each other and nothing else;
* only the named columns are read, so extra columns never clash (operators that return
  whole documents pass every other column through under names of their own);
* an empty table gives an empty result with the same schema;
* intermediate tables are Parquet files below ``spark.checkpoint.dir``.
"""
