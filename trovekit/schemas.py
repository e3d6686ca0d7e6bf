"""Fixed schemas; no reader of this package infers types."""

from pyspark.sql import types as T

CANDIDATE = T.StructType(
    [
        T.StructField("did", T.StringType()),
        T.StructField("txt", T.StringType()),
        T.StructField("img_path", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("src_content", T.StringType()),
    ]
)

QUERY = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("query_txt", T.StringType()),
        T.StructField("query_img_path", T.StringType()),
        T.StructField("query_modality", T.StringType()),
        T.StructField("query_src_content", T.StringType()),
        T.StructField("pos_cand_list", T.ArrayType(T.StringType())),
        T.StructField("neg_cand_list", T.ArrayType(T.StringType())),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("img", T.ArrayType(T.FloatType())),
        T.StructField("txt", T.ArrayType(T.FloatType())),
        T.StructField("img_mask", T.IntegerType()),
        T.StructField("txt_mask", T.IntegerType()),
    ]
)

CODEBOOK = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("centroid", T.ArrayType(T.DoubleType())),
    ]
)
