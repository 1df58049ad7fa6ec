"""Declared schemas and fixed vocabularies.

Output schemas are fixed: every one-hot / pivot takes its vocabulary from here
instead of from the values that happen to occur in a window.
"""

from pyspark.sql import types as T

# ---- fixed values (must equal the source system's codes) -------------------
# Action type codes 1..6; 4 is a purchase.
TYPES = (1, 2, 3, 4, 5, 6)
PURCHASE = 4
# Conversion ratios are purchases divided by each other type.
CONV_TYPES = (1, 2, 3, 5, 6)
# Category vocabulary and the target category.
CATES = (4, 5, 6, 7, 8, 9, 10, 11)
TARGET_CATE = 8
# model_id values that the model-id features count.
MODEL_IDS = (14, 21, 28, 110, 210)
# Age buckets as they appear in the user table, in code order 0..6.
AGE_BUCKETS = ("-1", "15岁以下", "16-25岁", "26-35岁", "36-45岁", "46-55岁", "56岁以上")
SEX_CODES = (0.0, 1.0, 2.0)
USER_LEVELS = (1, 2, 3, 4, 5)
# Product attribute codes (-1 = unknown).
ATTR_CODES = (-1, 0, 1, 2, 3)
COMMENT_NUM_CODES = (1, 2, 3, 4)
# Window sets.
USER_MODEL_DAY_WINDOWS = (1, 2, 3, 5, 7, 10, 15, 21, 30)
USER_MODEL_HOUR_WINDOWS = (4, 8, 16)
UI_DAY_WINDOWS = (1, 2, 3, 5, 10, 15, 21, 28, 35)
STAT_WINDOWS = (5, 30)
# -----------------------------------------------------------------------------

ACTION = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("sku_id", T.LongType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("model_id", T.IntegerType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("cate", T.IntegerType()),
    T.StructField("brand", T.IntegerType()),
])

USER = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("age", T.StringType()),
    T.StructField("sex", T.DoubleType()),
    T.StructField("user_lv_cd", T.IntegerType()),
    T.StructField("user_reg_tm", T.StringType()),
])

PRODUCT = T.StructType([
    T.StructField("sku_id", T.LongType()),
    T.StructField("a1", T.IntegerType()),
    T.StructField("a2", T.IntegerType()),
    T.StructField("a3", T.IntegerType()),
    T.StructField("cate", T.IntegerType()),
    T.StructField("brand", T.IntegerType()),
])

COMMENT = T.StructType([
    T.StructField("dt", T.DateType()),
    T.StructField("sku_id", T.LongType()),
    T.StructField("comment_num", T.IntegerType()),
    T.StructField("has_bad_comment", T.IntegerType()),
    T.StructField("bad_comment_rate", T.DoubleType()),
])

SCORES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("sku_id", T.LongType()),
    T.StructField("label", T.DoubleType()),
])

CANDIDATES = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("sku_id", T.LongType()),
    T.StructField("rank", T.IntegerType()),
])
