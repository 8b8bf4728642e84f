"""Column layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

FONT = T.StructType([
    T.StructField("font_name_cn", T.StringType()),
    T.StructField("font_name_en", T.StringType()),
    T.StructField("font_size_pt", T.DoubleType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
    T.StructField("underline", T.BooleanType()),
    T.StructField("color", T.StringType()),
])

PARA = T.StructType([
    T.StructField("alignment", T.StringType()),
    T.StructField("first_indent_chars", T.DoubleType()),
    T.StructField("first_indent_cm", T.DoubleType()),
    T.StructField("left_indent_cm", T.DoubleType()),
    T.StructField("right_indent_cm", T.DoubleType()),
    T.StructField("line_spacing_type", T.StringType()),
    T.StructField("line_spacing_value", T.DoubleType()),
    T.StructField("space_before_pt", T.DoubleType()),
    T.StructField("space_after_pt", T.DoubleType()),
    T.StructField("keep_with_next", T.BooleanType()),
])

RUN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("font_name", T.StringType()),
    T.StructField("font_size_pt", T.DoubleType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
    T.StructField("underline", T.BooleanType()),
    T.StructField("font_ascii", T.StringType()),
    T.StructField("font_hansi", T.StringType()),
    T.StructField("font_eastAsia", T.StringType()),
    T.StructField("font_cs", T.StringType()),
    T.StructField("is_in_field", T.BooleanType()),
])

RUNS = T.ArrayType(RUN)

# One structured element as front ends send it.
JSON_ELEMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("runs", RUNS),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
JSON_ELEMENTS = T.ArrayType(JSON_ELEMENT)

ELEMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("element_index", T.IntegerType()),
    T.StructField("element_type", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("style_name", T.StringType()),
    T.StructField("parent_index", T.IntegerType()),
    T.StructField("font", FONT),
    T.StructField("para", PARA),
    T.StructField("runs", RUNS),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

FIX_PAYLOAD = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("attr", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("para_idx", T.IntegerType()),
    T.StructField("para_fingerprint", T.StringType()),
    T.StructField("citation_text", T.StringType()),
    T.StructField("ref_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("ref_element_indices", T.ArrayType(T.IntegerType())),
])

# Every checker yields this struct; `doc_id` and `issue_id` are added around it.
ISSUE = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("checker", T.StringType()),
    T.StructField("element_index", T.IntegerType()),
    T.StructField("element_type", T.StringType()),
    T.StructField("location_text", T.StringType()),
    T.StructField("start_pos", T.IntegerType()),
    T.StructField("end_pos", T.IntegerType()),
    T.StructField("related_index", T.IntegerType()),
    T.StructField("related_text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("fixable", T.BooleanType()),
    T.StructField("fix_type", T.StringType()),
    T.StructField("fix_payload", FIX_PAYLOAD),
])
ISSUE_COLUMNS = [f.name for f in ISSUE.fields]

DOCUMENT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_format", T.StringType()),
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("element_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("level", T.IntegerType()),
    ]))),
])
