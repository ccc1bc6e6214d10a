"""Text scalars, extraction and mining over documents, pages and derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalogue.bindings import ACCESS, OPS, SNIPPETS, access, ops, snippets
from tidewright.catalogue.registry import query, table
from tidewright.functions import hashing, rules
from tidewright.functions import text as T
from tidewright.operators import extraction as X
from tidewright.operators import usage

LINK = r'<a href="([^"]*)">'


@query("extract_blocks", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS block_no, b[i] AS block FROM
 (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS b FROM pages))""")
def extract_blocks(spark, sf):
    return X.extract_blocks(table(spark, sf, "pages").select("page_id", "html"), "html", LINK)


@query("merge_strategies", r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<h2>([^<]*)</h2>', 1)) AS block FROM pages),
 f AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS block FROM pages)
 SELECT page_id, block FROM p UNION ALL SELECT page_id, block FROM f WHERE page_id NOT IN (SELECT page_id FROM p)""")
def merge_strategies(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    first = X.extract_blocks(pages, "html", "<h2>([^<]*)</h2>").drop("block_no")
    second = X.extract_blocks(pages, "html", "<h1>([^<]*)</h1>").drop("block_no")
    return X.merge_strategies(first, second, "page_id")


_KIND = r"""CASE WHEN regexp_matches(content, '(?m)^\s*mutation\s+') THEN 'mutation' WHEN regexp_matches(content, '(?m)^\s*subscription\s+') THEN 'subscription'
 WHEN regexp_matches(content, '(?m)^\s*query\s+') OR regexp_matches(content, '(?m)^\s*\{\s*') THEN 'query' END"""
_NAME = r"nullif(regexp_extract(content, '(query|mutation|subscription|fragment)\s+([A-Za-z_$][\w$]*)', 2), '')"
_HOLES = r"regexp_extract_all(content, '\$\{([^}]+)\}', 1)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(content, '(?m)#.*$', '', 'g'), '\$\{[^}]+\}', '${...}', 'g'), '\s+', ' ', 'g'))"


@query("operation_kind_and_name", f"""WITH {OPS} SELECT id, {_KIND} AS kind_found, {_NAME} AS name_found,
 CASE WHEN contains(content,'mutation') THEN 'mutation' WHEN contains(content,'subscription') THEN 'subscription' WHEN contains(content,'fragment') THEN 'fragment' ELSE 'query' END AS kind_by_word FROM ops""")
def operation_kind_and_name(spark, sf):
    c = F.col("content")
    return ops(spark, sf).select(
        "id", T.op_kind(c).alias("kind_found"), T.op_name(c).alias("name_found"), T.op_kind_by_word(c).alias("kind_by_word")
    )


@query("interpolations", f"""WITH {OPS} SELECT id, len({_HOLES}) AS holes, array_to_string({_HOLES}, ',') AS names,
 contains(content, '${{') AS has_any, contains(content, '${{queryNames.') AS uses_registry FROM ops""")
def interpolations(spark, sf):
    c = F.col("content")
    return ops(spark, sf).select(
        "id", F.size(T.interpolations(c)).cast("bigint").alias("holes"), F.array_join(T.interpolations(c), ",").alias("names"),
        T.has_interpolation(c).alias("has_any"), T.uses_registry(c).alias("uses_registry"),
    )


@query("normalize_text_operations", f"WITH {OPS} SELECT id, {_PLAIN} AS plain FROM ops")
def normalize_text_operations(spark, sf):
    return ops(spark, sf).select("id", T.normalize_text(F.col("content")).alias("plain"))


@query("normalize_text_documents", f"""SELECT doc_id, md5({_PLAIN.replace('content', 'text')}) AS plain_md5, length({_PLAIN.replace('content', 'text')}) AS plain_length FROM documents""")
def normalize_text_documents(spark, sf):
    plain = T.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(plain).alias("plain_md5"), F.length(plain).cast("bigint").alias("plain_length")
    )


_H = "list_reduce(list_transform(string_split({c}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, 0::BIGINT)"


@query("fingerprints", f"""WITH {OPS}, n AS (SELECT id, {_PLAIN} AS plain FROM ops), h AS (SELECT *, {_H.format(c='plain')} AS u FROM n),
 s AS (SELECT *, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS v FROM h)
 SELECT id, substr(sha256(plain), 1, 16) AS sha16, md5(plain) AS md5_hex, CASE WHEN v < 0 THEN '-' ELSE '' END || lower(to_base(abs(v), 36)) AS base36 FROM s""")
def fingerprints(spark, sf):
    rows = ops(spark, sf).select("id", T.normalize_text(F.col("content")).alias("plain"))
    p = F.col("plain")
    return rows.select(
        "id", hashing.fingerprint(p).alias("sha16"), hashing.fingerprint(p, "md5").alias("md5_hex"),
        hashing.fingerprint(p, "base36").alias("base36"),
    )


_ENDPOINTS = (("mobile", "//m.", ("track(7)", "reti ")), ("plain", ".org/", ("queli", "erreth")))


@query("classify_endpoint", """WITH t AS (SELECT page_id AS id, url AS path, html AS body FROM pages UNION ALL SELECT doc_id, source, text FROM documents)
 SELECT id, CASE WHEN contains(path, '//m.') OR contains(body, 'track(7)') OR contains(body, 'reti ') THEN 'mobile'
 WHEN contains(path, '.org/') OR contains(body, 'queli') OR contains(body, 'erreth') THEN 'plain' ELSE 'main' END AS endpoint FROM t""")
def classify_endpoint(spark, sf):
    def labelled(name, key, path, body):
        return table(spark, sf, name).select(
            F.col(key).alias("id"), T.classify_endpoint(F.col(path), F.col(body), _ENDPOINTS, "main").alias("endpoint")
        )

    return labelled("pages", "page_id", "url", "html").unionByName(labelled("documents", "doc_id", "source", "text"))


@query("infer_name", f"""WITH {OPS}, s AS (SELECT *, regexp_replace(split_part(file_path, '/', -1), '\\.[^.]+$', '') AS stem FROM ops)
 SELECT id, coalesce(CASE WHEN name <> '' AND name NOT LIKE '$%' AND name <> 'unnamed' THEN name END, {_NAME},
  CASE WHEN lower(stem) NOT IN ('index','queries','graphql') THEN upper(stem[1]) || stem[2:] || upper(kind[1]) || kind[2:] END, name) AS inferred FROM s""")
def infer_name(spark, sf):
    return ops(spark, sf).select(
        "id", T.infer_name(F.col("name"), F.col("content"), F.col("file_path"), F.col("kind")).alias("inferred")
    )


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+'), lambda w: w <> '')"


@query("normalize_name", f"""WITH {OPS}, w AS (SELECT id, name, {_WORDS} AS ws FROM ops),
 c AS (SELECT *, list_transform(ws, lambda w: upper(w[1]) || lower(w[2:])) AS caps FROM w)
 SELECT id, CASE WHEN len(ws) = 0 THEN name ELSE array_to_string(caps, '') END AS pascal,
  CASE WHEN len(ws) = 0 THEN name ELSE lower(ws[1]) || array_to_string(caps[2:], '') END AS camel FROM c""")
def normalize_name(spark, sf):
    n = F.col("name")
    return ops(spark, sf).select("id", T.normalize_name(n).alias("pascal"), T.normalize_name(n, "camel").alias("camel"))


@query("uniquify_names", r"""WITH c AS (SELECT event_id AS id, event_type || '_' || (user_id % 7) AS name, props AS body FROM events),
 n AS (SELECT *, trim(regexp_replace(regexp_replace(body, '(?m)#.*$', '', 'g'), '\s+', ' ', 'g')) AS plain FROM c),
 f AS (SELECT name, plain, min(id) AS first FROM n GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) - 1 AS sfx FROM f)
 SELECT id, name, CASE WHEN sfx = 0 THEN name ELSE name || '_' || sfx END AS unique_name FROM n JOIN r USING (name, plain)""")
def uniquify_names(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 7).cast("string")).alias("name"),
        F.col("props").alias("body"),
    )
    return X.uniquify_names(rows, "name", "body", "id").select("id", "name", "unique_name")


@query("hash_name", f"WITH {OPS} SELECT id, coalesce(nullif(name, ''), 'Query_' || substr(sha256(content), 1, 10)) AS query_name FROM ops")
def hash_name(spark, sf):
    return ops(spark, sf).select("id", T.hash_name(F.col("name"), F.col("content")).alias("query_name"))


@query("name_from_fields", f"""WITH {OPS} SELECT id, CASE kind WHEN 'mutation' THEN 'UpdateGet' WHEN 'subscription' THEN 'SubscribeGet' ELSE 'Get' END
 || CASE WHEN id % 13 = 0 THEN 'OrderConnection' ELSE 'Order' END AS generated FROM ops""")
def name_from_fields(spark, sf):
    rows = ops(spark, sf)
    body = F.regexp_replace("content", r"\A#.*\n", "")
    return rows.select(
        "id", X.name_from_field(X.root_field(body), F.col("kind"), T.file_stem(F.col("file_path"))).alias("generated")
    )


@query("standardize_operations", f"""WITH {OPS} SELECT CAST(id AS VARCHAR) AS id, coalesce(nullif(name, ''), 'Query_' || substr(sha256(content), 1, 10)) AS query_name, content, file_path,
 1 AS line_number, {_KIND} AS type, 'default' AS endpoint, 'ast' AS source, coalesce(fragment, '') AS fragments, false AS has_variables FROM ops""")
def standardize_operations(spark, sf):
    return X.standardize(ops(spark, sf))


@query("line_of_match", """SELECT doc_id, CAST(pos AS BIGINT) AS pos, 1 + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) AS line
 FROM (SELECT doc_id, text, instr(text, 'the ') - 1 AS pos FROM documents) WHERE pos >= 0""")
def line_of_match(spark, sf):
    pos = F.instr("text", "the ") - 1
    rows = table(spark, sf, "documents").select("doc_id", "text", pos.alias("pos")).filter("pos >= 0")
    return rows.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), T.line_of(F.col("text"), F.col("pos")).cast("bigint").alias("line")
    )


@query("path_and_version_labels", f"""WITH {OPS} SELECT id, split_part(file_path, '/', 3) AS component, regexp_replace(split_part(file_path, '/', -1), '\\.[^.]+$', '') AS export_name,
 CASE WHEN contains(name,'V3') THEN 'V3' WHEN contains(name,'V2') THEN 'V2' WHEN contains(name,'V1') THEN 'V1' WHEN contains(name,'Latest') THEN 'V3' ELSE 'V1' END AS version,
 CASE WHEN regexp_matches(name, 'V[0-9]') THEN NULL WHEN contains(name,'byId') THEN replace(name,'byId','byIdV2') WHEN contains(name,'getUser') THEN replace(name,'getUser','getUserV2') END AS replacement FROM ops""")
def path_and_version_labels(spark, sf):
    return ops(spark, sf).select(
        "id", T.component_of(F.col("file_path")).alias("component"), T.file_stem(F.col("file_path")).alias("export_name"),
        T.detect_version(F.col("name")).alias("version"), T.suggest_replacement(F.col("name")).alias("replacement"),
    )


@query("spread_refs", f"""WITH {OPS} SELECT id, coalesce(fragment, '') AS refs FROM ops""")
def spread_refs(spark, sf):
    return ops(spark, sf).select("id", F.array_join(T.spread_refs(F.col("content")), ",").alias("refs"))


_ENTITY = """CASE WHEN id % 4 = 1 THEN 'order' WHEN id % 4 = 3 THEN 'basket' WHEN id % 4 = 0 THEN 'store' ELSE 'listing' END"""


@query("mine_access", f"""WITH {SNIPPETS},
 pick AS (SELECT id, unnest(regexp_extract_all(regexp_extract(code, 'entityPick\\s*\\(\\s*(\\w+)\\s*,\\s*\\[([\\s\\S]*?)\\]\\s*\\)', 2), '[''"`]([^''"`]+)[''"`]', 1)) AS field, 'pick' AS access_method FROM snippets),
 req AS (SELECT id, 'request.query.' || unnest(regexp_extract_all(code, 'profile\\.request\\.query\\.(\\w+)', 1)) AS field, 'direct' AS access_method FROM snippets),
 dir AS (SELECT id, unnest(list_zip(regexp_extract_all(code, '{X.DIRECT}', 1), regexp_extract_all(code, '{X.DIRECT}', 2))) AS z FROM snippets),
 des AS (SELECT id, trim(split_part(unnest(string_split(regexp_extract(code, 'const\\s*\\{{([^}}]+)\\}}\\s*=\\s*(\\w+)', 1), ',')), ':', 1)) AS field, 'destructuring' AS access_method FROM snippets)
 SELECT id AS unit, field, field AS normalized, {_ENTITY} AS entity_type, access_method FROM (SELECT * FROM pick UNION ALL SELECT * FROM des)
 UNION ALL SELECT id, field, field, 'profile', access_method FROM req
 UNION ALL SELECT id, replace(z[2], '?.', '.'), replace(z[2], '?.', '.'), CASE WHEN id % 4 = 1 THEN 'order' WHEN z[1] = 'l' THEN 'cart' WHEN z[1] = 'r' THEN 'user' ELSE {_ENTITY} END, 'direct'
 FROM dir WHERE z[1] NOT IN ('profile','entity','console','Object','Array','Math')""")
def mine_access(spark, sf):
    return X.mine_access(snippets(spark, sf), "id", "code", hints=(("shop", "store"), ("list", "listing")))


@query("mine_join_keys", f"""WITH {SNIPPETS} SELECT id AS unit, unnest(['l.ownerId', 'l.k']) AS "left", unnest(['r.userId', 'r.k']) AS "right" FROM snippets WHERE id % 3 = 0""")
def mine_join_keys(spark, sf):
    return X.mine_join_keys(snippets(spark, sf), "id", "code")


@query("snippet_profile", f"""WITH {SNIPPETS}, d AS (SELECT s.*, len(list_distinct(list_concat(list_transform(r.selections, lambda x: 'gem.' || x),
   list_concat([r.s1, r.sn, r.sn || '.current', 'request.query.page'],
   list_concat(CASE WHEN id % 3 = 0 THEN ['type', 'ownerId', 'userId', 'k'] ELSE [] END, CASE WHEN id % 4 = 3 THEN ['type'] ELSE [] END))))) AS f
   FROM snippets s JOIN snip_raw r USING (id)),
 q AS (SELECT id, f AS fields, len(list_distinct(regexp_extract_all(code, 'type\\s*===\\s*[''"`](\\w+)[''"`]', 1))) AS entities, contains(code, 'joinEntities') AS uses_join,
   contains(code, 'if') OR contains(code, '?') AS conditional, contains(code, '...') AS uses_spread, contains(code, '?.') AS optional_chaining, length(code) AS length,
   CASE id % 5 WHEN 0 THEN 'empty_array' WHEN 1 THEN 'static_none' WHEN 2 THEN 'spread_operator' WHEN 3 THEN 'venture_based' ELSE 'dynamic' END AS return_shape,
   2 * CAST(contains(code, 'joinEntities') AS INT) + CAST(contains(code, 'filter') AS INT) + CAST(contains(code, 'map') AS INT) + CAST(contains(code, 'find') AS INT)
    + CAST(contains(code, 'request.query') AS INT) + CAST(length(code) > 500 AS INT) + 2 * CAST(length(code) > 1000 AS INT) AS light FROM d),
 z AS (SELECT *, 3 * CAST(uses_join AS INT) + 2 * CAST(fields > 10 AS INT) + 2 * CAST(entities > 1 AS INT) + 2 * CAST(length > 1000 AS INT) + CAST(conditional AS INT) AS score FROM q)
 SELECT id AS unit, CAST(fields AS BIGINT) AS fields, CAST(entities AS BIGINT) AS entities, uses_join, conditional, uses_spread, optional_chaining, CAST(length AS BIGINT) AS length, return_shape,
  CASE WHEN light <= 2 THEN 'simple' WHEN light <= 5 THEN 'medium' ELSE 'complex' END AS light_level, CAST(score AS BIGINT) AS score,
  CASE WHEN score <= 2 THEN 'simple' WHEN score <= 5 THEN 'medium' ELSE 'complex' END AS level,
  array_to_string(list_filter([CASE WHEN uses_join THEN 'uses_join_entities' END, CASE WHEN fields > 10 THEN 'many_fields' END, CASE WHEN entities > 1 THEN 'multiple_entities' END,
   CASE WHEN length > 1000 THEN 'long_code' END, CASE WHEN conditional THEN 'complex_conditions' END], lambda x: x IS NOT NULL), ',') AS factors,
  CASE WHEN return_shape IN ('empty_array','static_none') THEN 'static_return' WHEN return_shape = 'venture_based' THEN 'venture_based' WHEN uses_join THEN 'entity_join'
   WHEN score >= 5 THEN 'complex_logic' WHEN conditional THEN 'conditional_return' ELSE 'simple_entity_filter' END AS construct FROM z""")
def snippet_profile(spark, sf):
    rows = X.profile_snippets(snippets(spark, sf), "id", "code")
    return rows.select(
        "unit", *[F.col(c).cast("bigint").alias(c) for c in ("fields", "entities", "length", "score")],
        "uses_join", "conditional", "uses_spread", "optional_chaining", "return_shape", "light_level", "level",
        F.array_join("factors", ",").alias("factors"), "construct",
    )


@query("label_distribution", f"""WITH {SNIPPETS}, r AS (SELECT CASE id % 5 WHEN 0 THEN 'empty_array' WHEN 1 THEN 'static_none' WHEN 2 THEN 'spread_operator' WHEN 3 THEN 'venture_based' ELSE 'dynamic' END AS label FROM snippets)
 SELECT label, count(*) AS n FROM r GROUP BY 1""")
def label_distribution(spark, sf):
    return snippets(spark, sf).groupBy(T.return_shape(F.col("code")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("access_advice", f"""WITH {SNIPPETS}, {ACCESS}, v AS (SELECT count(DISTINCT field) AS c FROM access GROUP BY normalized),
 r AS (SELECT count_if(c > 1) AS varied_fields, count_if(c > 2) AS inconsistent_fields FROM v),
 s AS (SELECT count_if(length(code) > 700) AS complex_units, count_if(id % 5 < 2) AS static_units FROM snippets)
 SELECT *, inconsistent_fields > 0 AS standardize_fields, complex_units > 5 AS simplify_units, static_units > 10 AS review_static FROM r, s""")
def access_advice(spark, sf):
    code = F.col("code")
    profiles = snippets(spark, sf).select(
        F.when(F.length(code) > 700, "complex").otherwise("simple").alias("level"), T.return_shape(code).alias("return_shape")
    )
    return usage.advice(access(spark, sf), profiles)


@query("normalize_deep", f"""WITH {ACCESS} SELECT field, coalesce(CASE field WHEN 'economy.brand_3' THEN 'money.third' WHEN 'promo.brand_9' THEN 'offer.ninth' END, field) AS normalized, count(*) AS n
 FROM raw_access GROUP BY 1, 2""")
def normalize_deep(spark, sf):
    exact = spark.createDataFrame(
        [("economy.brand_3", "money.third"), ("promo.brand_9", "offer.ninth")], "field string, normalized string"
    )
    rows = access(spark, sf).drop("normalized")
    return X.normalize_deep(rows, "field", exact).groupBy("field", "normalized").agg(F.count(F.lit(1)).alias("n"))


def _contains_case(col, rule_set, default):
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{label}'" for label, _, words in rule_set
    )
    return f"CASE {arms} ELSE '{default}' END"


@query("categorize_words", f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
 SELECT {_contains_case('lower(word)', rules.FIELD_CATEGORIES, 'Other')} AS category, {_contains_case('word', rules.USAGE_PATTERNS, 'none')} AS pattern,
 {_contains_case('word', rules.DATA_TYPES, 'string')} AS dtype, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def categorize_words(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    w = F.col("word")
    return words.groupBy(
        rules.categorize(w, rules.FIELD_CATEGORIES, ignore_case=True).alias("category"),
        rules.categorize(w, rules.USAGE_PATTERNS, "none").alias("pattern"),
        rules.infer_dtype(w).alias("dtype"),
    ).agg(F.count(F.lit(1)).alias("n"))


_BODIES = (("status", "state ${unit}"), ("queryNames.item", "x"), ("unit", "kg"))


@query("resolve_templates", f"""WITH {OPS} SELECT id, replace(content, '${{status}}', 'state kg') AS content FROM ops""")
def resolve_templates(spark, sf):
    bodies = spark.createDataFrame(list(_BODIES), "name string, text string")
    return X.resolve_templates(ops(spark, sf), "id", "content", bodies)


@query("query_pattern", f"""WITH {OPS} SELECT id, CASE WHEN id % 5 = 1 THEN 'SUBSCRIPTION' WHEN id % 13 = 0 THEN 'PAGINATED_QUERY' ELSE 'NESTED_QUERY' END AS pattern,
 CAST(CASE WHEN id % 4 = 0 THEN 3 ELSE 2 END AS INTEGER) AS depth FROM ops""")
def query_pattern(spark, sf):
    c = F.col("content")
    return ops(spark, sf).select("id", T.query_pattern(c).alias("pattern"), T.brace_depth(c).alias("depth"))


@query("migration_pattern", """SELECT a.conv_id, a.turn, CASE WHEN contains(a.text, 'the') AND contains(b.text, 'and') AND false THEN ''
 WHEN len(regexp_extract_all(a.text, '(\\w+)\\s*[:{]', 1)) <> len(regexp_extract_all(b.text, '(\\w+)\\s*[:{]', 1)) THEN 'FIELD_SELECTION_CHANGE' ELSE 'UNKNOWN_PATTERN' END AS pattern
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
 UNION ALL SELECT page_id, -1, CASE WHEN regexp_matches(html, 'https') THEN 'EDGE_TO_NODE_MIGRATION' ELSE 'PAGINATION_REMOVAL' END FROM pages""")
def migration_pattern(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    talk = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", T.migration_pattern(F.col("text"), F.col("after")).alias("pattern"))
    html = F.col("html")
    old = F.when(html.contains("https"), F.concat(html, F.lit("{edges{node}}"))).otherwise(F.concat(html, F.lit("{pageInfo}")))
    new = F.when(html.contains("https"), F.concat(html, F.lit("{nodes}"))).otherwise(html)
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), T.migration_pattern(old, new).alias("pattern")
    )
    return talk.unionByName(pages)


_TOK = T.TOKEN_PATTERN.replace("'", "''")


@query("tokens", f"""SELECT id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS token FROM
 (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT event_id AS id, regexp_extract_all(props, '{_TOK}', 1) AS t FROM events))""")
def tokens(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.posexplode(T.tokens(F.col("props"))).alias("pos", "token")
    )


@query("token_counts_conversations", f"""SELECT conv_id, turn, len(regexp_extract_all(text, '{_TOK}', 1)) AS n, md5(array_to_string(regexp_extract_all(text, '{_TOK}', 1), '|')) AS digest FROM conversations""")
def token_counts_conversations(spark, sf):
    t = T.tokens(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, "|")).alias("digest")
    )


@query("edge_values", """WITH v AS (SELECT DISTINCT p_brand AS variable, CASE p_size % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Boolean' WHEN 2 THEN 'Float' ELSE 'Object' END AS dtype FROM part),
 e(dtype, probes) AS (VALUES ('Int', ['0','1','-1','2147483647','-2147483648','null']), ('Boolean', ['true','false','null']),
  ('Float', ['0.0','1.0','-1.0','0.00000001','999999999.99','null']), ('Object', ['{}','{"key":"value"}','null']))
 SELECT variable, dtype, CAST(i - 1 AS INTEGER) AS probe_no, probes[i] AS probe FROM (SELECT *, unnest(range(1, len(probes) + 1)) AS i FROM v JOIN e USING (dtype))""")
def edge_values(spark, sf):
    s = F.col("p_size") % 4
    variables = table(spark, sf, "part").select(
        F.col("p_brand").alias("variable"),
        F.when(s == 0, "Int").when(s == 1, "Boolean").when(s == 2, "Float").otherwise("Object").alias("dtype"),
    ).distinct()
    return X.edge_values(variables, "variable", "dtype")


@query("common_keys", """SELECT 'k' AS key, count(*) AS examples, 'number' AS types, min_by(json_extract_string(props, '$.k'), event_id) AS sample FROM events
 UNION ALL SELECT 'v', count(*), 'string', min_by(event_type, event_id) FROM events WHERE event_type IN ('view','click','signup')""")
def common_keys(spark, sf):
    e = table(spark, sf, "events")
    extra = F.when(
        F.col("event_type").isin("view", "click", "signup"),
        F.concat(F.lit(', "v": "'), "event_type", F.lit('"}')),
    ).when(F.col("event_type") == "error", ', "w": null}').otherwise("}")
    rows = e.select("event_id", F.concat(F.expr("substr(props, 1, length(props) - 1)"), extra).alias("payload"))
    return X.common_keys(rows, "event_id", "payload")


@query("dedupe_first", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY 1")
def dedupe_first(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id", "source")
    return X.dedupe_first(rows, ["digest"], "doc_id")


@query("duplicate_groups", f"""WITH d AS (SELECT doc_id, substr(sha256({_PLAIN.replace('content', 'text')}), 1, 16) AS fingerprint FROM documents)
 SELECT fingerprint, count(*) AS members, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    fp = hashing.fingerprint(T.normalize_text(F.col("text")))
    return X.duplicate_groups(table(spark, sf, "documents"), fp, "doc_id")


@query("duplicate_members", f"""WITH d AS (SELECT doc_id, substr(sha256({_PLAIN.replace('content', 'text')}), 1, 16) AS fingerprint FROM documents),
 g AS (SELECT fingerprint, count(*) AS members, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, fingerprint, members, first_id FROM d JOIN g USING (fingerprint)""")
def duplicate_members(spark, sf):
    fp = hashing.fingerprint(T.normalize_text(F.col("text")))
    return X.duplicate_members(table(spark, sf, "documents"), fp, "doc_id")


@query("count_by_kind", f"WITH {OPS} SELECT kind, count(*) AS operations, count(DISTINCT file_path) AS files FROM ops GROUP BY 1")
def count_by_kind(spark, sf):
    return ops(spark, sf).groupBy("kind").agg(
        F.count(F.lit(1)).alias("operations"), F.countDistinct("file_path").alias("files")
    )


@query("union_of_sources", """SELECT 'document' AS origin, doc_id AS id, length(text) AS chars FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages
 UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark""")
def union_of_sources(spark, sf):
    def part(name, key, text):
        return table(spark, sf, name[1]).select(
            F.lit(name[0]).alias("origin"), F.col(key).alias("id"), F.length(text).cast("bigint").alias("chars")
        )

    docs = part(("document", "documents"), "doc_id", "text")
    return docs.unionByName(part(("page", "pages"), "page_id", "html")).unionByName(part(("benchmark", "benchmark"), "item_id", "text"))


@query("read_sections", r"""WITH s AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages)
 SELECT page_id, CAST(i - 1 AS INTEGER) AS section_no, parts[i] AS section FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM s)""")
def read_sections(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("section_no", "section"))
    return rows.filter("section_no > 0")
