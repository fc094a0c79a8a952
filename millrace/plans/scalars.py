"""Queries over scalar functions and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import scalar as X
from millrace.plans.registry import query, r6


@query("X01_replace_all", "SELECT page_id, replace(url, '/', '::') AS v FROM pages")
def x01(t):
    return t.pages.select("page_id", F.replace("url", F.lit("/"), F.lit("::")).alias("v"))


@query("X02_trim", "SELECT doc_id, trim('  ' || lang || ' ') AS v FROM documents")
def x02(t):
    return t.documents.select("doc_id", F.trim(F.concat(F.lit("  "), F.col("lang"), F.lit(" "))).alias("v"))


@query("X03_split_drop_empty", "SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS v FROM pages")
def x03(t):
    return t.pages.select("page_id", X.split_tokens(F.col("url"), "/").alias("v"))


@query("X04_split_dots", "SELECT page_id, list_filter(string_split(url, '.'), lambda x: x <> '') AS v FROM pages")
def x04(t):
    return t.pages.select("page_id", X.split_tokens(F.col("url"), r"\.").alias("v"))


@query("X05_regex_int", "SELECT page_id, coalesce(try_cast(regexp_extract(url, '([0-9]+)', 1) AS BIGINT), 0) AS v FROM pages")
def x05(t):
    return t.pages.select("page_id", X.regex_int(F.col("url"), "([0-9]+)").alias("v"))


@query("X06_hex_padded", "SELECT o_orderkey, CASE WHEN length(to_hex(o_orderkey)) >= 3 THEN lower(to_hex(o_orderkey)) ELSE lpad(lower(to_hex(o_orderkey)), 3, '0') END AS v FROM orders")
def x06(t):
    return t.orders.select("o_orderkey", X.hex_padded(F.col("o_orderkey"), 3).alias("v"))


@query("X07_hex_parsed", "SELECT o_orderkey, o_orderkey * 31 AS v FROM orders")
def x07(t):
    return t.orders.select("o_orderkey", X.hex_parsed(F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 31))).alias("v"))


@query("X08_ends_with", "SELECT p_partkey, ends_with(p_brand, '1') AS v FROM part")
def x08(t):
    return t.part.select("p_partkey", F.endswith("p_brand", F.lit("1")).alias("v"))


@query("X09_slug", "SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'NO_ARGS' ELSE translate(url, ' /.-=><,', '________') END AS v FROM pages")
def x09(t):
    return t.pages.select("page_id", X.slug(F.col("url")).alias("v"))


@query("X10_substring", "SELECT c_custkey, substring(c_name, 3, 6) AS v FROM customer")
def x10(t):
    return t.customer.select("c_custkey", F.substring("c_name", 3, 6).alias("v"))


@query("X11_case", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l FROM customer")
def x11(t):
    return t.customer.select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"))


@query("X12_struct_key", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def x12(t):
    keyed = t.customer.select(F.struct("c_mktsegment", "c_nationkey").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return keyed.select("k.c_mktsegment", "k.c_nationkey", "n")


@query("X13_word_only", "SELECT page_id, regexp_replace(url, '[^0-9a-zA-Z]+', '_', 'g') AS v FROM pages")
def x13(t):
    return t.pages.select("page_id", X.word_only(F.col("url")).alias("v"))


@query("X14_bit_field", "SELECT o_orderkey, (o_orderkey >> 3) & 15 AS v FROM orders")
def x14(t):
    return t.orders.select("o_orderkey", X.bit_field(F.col("o_orderkey"), 3, 4).alias("v"))


@query("X15_popcount_ffs", "SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, CASE WHEN o_orderkey = 0 THEN 0 ELSE CAST(log2(o_orderkey & -o_orderkey) AS INTEGER) + 1 END AS first FROM orders")
def x15(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.bit_count(k).alias("ones"), X.first_set(k).alias("first"))


@query("X16_xor_index", "SELECT o_orderkey, xor(o_orderkey, o_custkey & 63) AS v FROM orders")
def x16(t):
    return t.orders.select("o_orderkey", X.xor_index(F.col("o_orderkey"), F.col("o_custkey"), 64).alias("v"))


@query("X17_polynomial_hash", "SELECT o_orderkey, xor(xor(o_orderkey & 1, (o_orderkey >> 2) & 1), (o_orderkey >> 5) & 1) | (xor((o_orderkey >> 1) & 1, (o_orderkey >> 4) & 1) << 1) AS v FROM orders")
def x17(t):
    return t.orders.select("o_orderkey", X.polynomial_hash(F.col("o_orderkey"), [[0, 2, 5], [1, 4]]).alias("v"))


@query("X18_md5", "SELECT doc_id, md5(text) AS v FROM documents")
def x18(t):
    return t.documents.select("doc_id", F.md5("text").alias("v"))


@query("X19_linear_index", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * 50 * 100 + CAST(l_quantity AS BIGINT) * 100 + l_suppkey % 100 AS v FROM lineitem")
def x19(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.linear_index(F.col("l_suppkey") % 100, F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint"), 100, 50).alias("v"))


@query("X20_ceil_clamp", "SELECT o_orderkey, CAST(ceil(o_orderkey / 7) AS BIGINT) AS c, greatest(100, least(o_custkey, 900)) AS k FROM orders")
def x20(t):
    return t.orders.select("o_orderkey", X.ceil_div(F.col("o_orderkey"), 7).alias("c"), X.clamp(F.col("o_custkey"), 100, 900).cast("bigint").alias("k"))


@query("X21_float_functions", "SELECT event_id, round(sqrt(value), 6) AS a, round(ln(value + 1), 6) AS b, round(sin(value) + cos(value), 6) AS c, round(greatest(0, least(1, value / 50)), 6) AS d, round(exp(-value / 100), 6) AS e, round(pow(value, 1.5), 4) AS f FROM events")
def x21(t):
    v = F.col("value")
    cols = {"a": F.sqrt(v), "b": F.log(v + 1), "c": F.sin(v) + F.cos(v), "d": X.clamp(v / 50, 0.0, 1.0), "e": F.exp(-v / 100)}
    return t.events.select("event_id", *(r6(c).alias(n) for n, c in cols.items()), r6(F.pow(v, F.lit(1.5)), 4).alias("f"))


@query("X22_integer_ops", "SELECT o_orderkey, o_orderkey % 7 AS r, (o_orderkey & 12) | 3 AS o, o_orderkey << 2 AS s, CASE WHEN o_orderkey = 0 THEN 64 ELSE 63 - CAST(floor(log2(o_orderkey)) AS INTEGER) END AS z, abs(o_orderkey - o_custkey) AS d, -o_orderkey - 1 AS n FROM orders")
def x22(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", (k % 7).alias("r"), k.bitwiseAND(F.lit(12)).bitwiseOR(F.lit(3)).alias("o"), F.shiftleft(k, 2).alias("s"), X.leading_zeros(k).alias("z"), F.abs(k - F.col("o_custkey")).alias("d"), F.bitwise_not(k).alias("n"))


@query("X23_rounding_casts", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS rz, CAST(ceil(value) AS BIGINT) AS ru, CAST(floor(value) AS BIGINT) AS rd, CAST(round_even(value, 0) AS BIGINT) AS rn FROM events")
def x23(t):
    v = F.col("value")
    return t.events.select("event_id", v.cast("bigint").alias("rz"), F.ceil(v).alias("ru"), F.floor(v).alias("rd"), F.rint(v).cast("bigint").alias("rn"))


@query("X24_guarded_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS v FROM lineitem")
def x24(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(X.guarded_ratio(F.col("l_tax"), F.col("l_discount"))).alias("v"))


@query("X25_percent_difference", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_tax) < 0.01 AND abs(l_discount) < 0.01 THEN 0 ELSE 100 * abs(abs(l_tax - l_discount) / abs(l_tax + 1e-8)) END, 3) AS v FROM lineitem WHERE l_tax > 0")
def x25(t):
    return t.lineitem.where("l_tax > 0").select("l_orderkey", "l_linenumber", r6(X.percent_difference(F.col("l_tax"), F.col("l_discount")), 3).alias("v"))


@query("X26_planar_distance", "SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_quantity - 25, 2) + pow(l_linenumber - 4, 2)), 6) AS v FROM lineitem")
def x26(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(X.planar_distance(F.col("l_quantity"), F.col("l_linenumber"), 25.0, 4.0)).alias("v"))


@query("X27_squared_distance", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS v FROM embeddings")
def x27(t):
    return t.embeddings.select("vec_id", r6(X.squared_distance(F.col("embedding"), F.transform("embedding", lambda x: x - x))).alias("v"))


@query("X28_bin_edges", "SELECT range AS k, round(cos(pow(10, log10(1.0) + range / 5.0) / 60 * pi() / 180), 9) AS edge FROM range(21)")
def x28(t):
    return t.spark.range(21).select(F.col("id").alias("k"), F.round(F.cos(F.pow(F.lit(10.0), F.log10(F.lit(1.0)) + F.col("id") / 5.0) / 60 * F.pi() / 180), 9).alias("edge"))


@query("X30_code_lengths", "SELECT p_partkey, string_agg(CASE c WHEN 'B' THEN '0' WHEN '#' THEN '10' ELSE '11' END, '' ORDER BY k) AS code FROM (SELECT p_partkey, unnest(string_split(p_brand, '')) AS c, generate_subscripts(string_split(p_brand, ''), 1) AS k FROM part) GROUP BY 1")
def x30(t):
    code = F.create_map(F.lit("B"), F.lit("0"), F.lit("#"), F.lit("10"))
    return t.part.select("p_partkey", F.array_join(F.transform(F.split("p_brand", ""), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("11"))), "").alias("code"))


@query("X31_lane_addresses", "SELECT o_orderkey, list_transform(range(CAST(bit_count(o_orderkey & 255) AS BIGINT)), lambda k: o_custkey + k * 4) AS v FROM orders")
def x31(t):
    return t.orders.select("o_orderkey", X.lane_addresses(F.col("o_custkey"), F.lit(4).cast("bigint"), F.col("o_orderkey").bitwiseAND(F.lit(255)), 8).alias("v"))


@query("X32_delta_addresses", "SELECT o_orderkey, [o_custkey, o_custkey + 4, o_custkey + 4 + o_orderkey, o_custkey + 2 + o_orderkey] AS v FROM orders")
def x32(t):
    return t.orders.select("o_orderkey", X.delta_addresses(F.col("o_custkey"), F.array(F.lit(4).cast("bigint"), F.col("o_orderkey"), F.lit(-2).cast("bigint"))).alias("v"))


@query("X33_mask_defaults", "SELECT o_orderkey, CASE WHEN o_orderkey & 1 <> 0 THEN 4294967295 ELSE o_custkey END AS active, CASE WHEN o_orderkey & 2 <> 0 THEN CASE WHEN o_orderkey & 1 <> 0 THEN 4294967295 ELSE o_custkey END ELSE 7 END AS predicate FROM orders")
def x33(t):
    a, p = X.filled_masks(F.col("o_orderkey"), F.col("o_custkey"), F.lit(7))
    return t.orders.select("o_orderkey", a.alias("active"), p.alias("predicate"))


@query("X34_expand_run", "SELECT p_partkey, p_partkey + k * 16 AS pc FROM part, LATERAL (SELECT unnest(range(CAST(p_size AS BIGINT))) AS k)")
def x34(t):
    return t.part.select("p_partkey", F.explode(X.expanded_run(F.col("p_partkey"), F.lit(16).cast("bigint"), F.col("p_size"))).alias("pc"))


@query("X35_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS v FROM orders")
def x35(t):
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("other")).alias("v"))


@query("X36_format", "SELECT o_orderkey, printf('%d:%.2f', o_orderkey, o_totalprice) AS v FROM orders")
def x36(t):
    return t.orders.select("o_orderkey", F.format_string("%d:%.2f", "o_orderkey", "o_totalprice").alias("v"))


@query("X37_date_format", "SELECT event_id, strftime(ts, '%y.%m.%d-%A') AS d, strftime(ts, '%H:%M:%S') AS h FROM events")
def x37(t):
    return t.events.select("event_id", F.date_format("ts", "yy.MM.dd-EEEE").alias("d"), F.date_format("ts", "HH:mm:ss").alias("h"))


@query("X38_duration_parse", "SELECT o_orderkey, CAST(o_custkey % 100 AS INTEGER) AS v FROM orders")
def x38(t):
    text = F.concat(F.lit("0 days, 0 hrs ("), (F.col("o_custkey") % 100).cast("string"), F.lit(" sec)"))
    return t.orders.select("o_orderkey", X.seconds_in_parentheses(text).alias("v"))


@query("X39_bit_permutations", "SELECT k, 255 - k AS c, ((k & 15) << 4) | (k >> 4) AS tr, ((k << 1) & 255) | (k >> 7) AS ro, CAST(list_sum(list_transform(range(8), lambda b: ((k >> b) & 1) << (7 - b))) AS BIGINT) AS re FROM (SELECT range AS k FROM range(256))")
def x39(t):
    k = F.col("id")
    return t.spark.range(256).select(k.alias("k"), X.bit_complement(k, 8).alias("c"), X.bit_transposed(k, 8).alias("tr"), X.bit_rotated(k, 8).alias("ro"), X.bit_reversed(k, 8).alias("re"))


@query("X29_edit_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def x29(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("d"))


@query("X29_global_alignment")
def x29b(t):
    """Alignment score with match +2, mismatch -1, gap -1 of each part's name with its brand."""
    from millrace.functions.alignment import global_alignment

    return t.part.select("p_partkey", global_alignment(2, -1, -1)("p_name", "p_brand").alias("score"))


@query("X40_local_alignment")
def x40(t):
    from millrace.functions.alignment import local_alignment

    return t.part.select("p_partkey", local_alignment(2, -1, -1)("p_name", "p_type").alias("score"))


@query("E01_scalar_functor", "SELECT event_id, round(value * 2 + 1, 6) AS v FROM events WHERE value > 10")
def e01(t):
    functor = lambda c: c * 2 + 1
    return t.events.where(F.col("value") > 10).select("event_id", r6(functor(F.col("value"))).alias("v"))


@query("E02_user_reduction", "SELECT user_id, CAST(bit_xor(event_id) AS BIGINT) AS v FROM events GROUP BY 1")
def e02(t):
    """A user's binary operator, folded over each group's values within Arrow batches."""

    @F.pandas_udf("bigint")
    def fold(v: pd.Series) -> int:
        out = 0
        for x in v:
            out ^= int(x)
        return out

    return t.events.groupBy("user_id").agg(fold("event_id").alias("v"))


@query("E05_row_generator", "SELECT o_orderkey, k AS lane FROM orders, LATERAL (SELECT unnest(range(8)) AS k) WHERE (o_custkey >> k) & 1 = 1")
def e05(t):
    return t.orders.select("o_orderkey", F.explode(F.transform(X.active_lanes(F.col("o_custkey"), 8), lambda k: k.cast("bigint"))).alias("lane"))


@query("E06_even_share", "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS block, count(*) AS n FROM orders GROUP BY 1")
def e06(t):
    return t.orders.repartition("o_orderkey").groupBy(F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("block")).agg(F.count("*").alias("n"))
