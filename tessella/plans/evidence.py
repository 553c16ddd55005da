"""Queries on descriptions, contracts, citations and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import pixels
from tessella.functions import text as T
from tessella.functions.negation import stated_terms
from tessella.functions.policy import sampling
from tessella.operators import calls, contract, decisions, evidence, joins, review
from tessella.plans.registry import query, table

_TEXT = "coalesce(text, '')"


@query("""SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0, false) AS clean FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id""")
def clean_left_join(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return joins.with_flag(table(spark, sf_dir, "documents").select("doc_id"), good, ["doc_id"], "clean")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
    FROM (SELECT DISTINCT doc_id FROM documents) AS d FULL JOIN (SELECT DISTINCT doc_id FROM labels) AS l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def id_set_equality(spark, sf_dir):
    return joins.set_differences(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""WITH k AS (SELECT DISTINCT left(c_name, 16) AS key FROM customer UNION ALL SELECT DISTINCT 'Client#' || left(p_name, 3) FROM part)
    SELECT key, coalesce((SELECT min(c_name) FROM customer WHERE left(c_name, 16) = key), key) AS resolved FROM k""")
def prefix_key_resolution(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    keys = c.select(F.substring("c_name", 1, 16).alias("key")).distinct().union(p.select(F.concat(F.lit("Client#"), F.substring("p_name", 1, 3))).distinct())
    return joins.resolve_prefix(keys, c, "key", "c_name", shortest=10)


@query(f"SELECT doc_id, source || '_' || left(md5({_TEXT}), 8) AS unique_id FROM documents")
def unique_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.unique_id(F.col("source"), F.coalesce("text", F.lit(""))).alias("unique_id"))


_CLAIMS = "'. The breast shows Carcinoma in situ. KRAS mutation was noted! Solid nests; Benign-looking glands near ovary. Ringed pattern.'"


@query(rf"""WITH t AS (SELECT doc_id, {_TEXT} || {_CLAIMS} AS x FROM documents),
    a AS (SELECT doc_id, regexp_replace(x, '(?i)ringed pattern', '[diagnostic label omitted]', 'g') AS x FROM t),
    b AS (SELECT doc_id, regexp_replace(x, '(?i)\b(?:carcinoma|benign)\b', '[diagnostic label omitted]', 'g') AS x FROM a),
    c AS (SELECT doc_id, regexp_replace(x, '(?i)\b(?:breast|ovary)\b', '[organ label omitted]', 'g') AS x FROM b),
    s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|[\r\n]+') AS s FROM c),
    k AS (SELECT doc_id, list_filter(list_transform(s, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '' AND NOT regexp_matches(y, '(?i)\b(?:KRAS|mutation)\b')) AS s FROM s)
    SELECT doc_id, md5('[OFFLINE_MORPHOLOGY_SANITIZED] ' || array_to_string(s, ' ')) AS digest, len(s) AS sentences FROM k""")
def sanitize_text(spark, sf_dir):
    """Redaction and sentence filter over every document with a few claims put behind it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(_CLAIMS.strip("'"))).alias("x"))
    kept = d.select("doc_id", T.clean_sentences(F.col("x"), ["Ringed pattern"]).alias("kept"))
    return kept.select("doc_id", F.md5(T.tagged(F.col("kept")).cast("binary")).alias("digest"), F.size("kept").cast("long").alias("sentences"))


@query(rf"SELECT doc_id, md5(regexp_replace({_TEXT}, '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def visible_section(spark, sf_dir):
    """Two of three documents are wrapped in the fields of a description; the section is the document either way."""
    text = F.coalesce("text", F.lit(""))
    wrapped = F.concat(F.lit("NOTE: x\n visible : "), text, F.lit("\nABSENT_OR_NOT_SEEN: none\nVISIBLE: more"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, text).otherwise(wrapped).alias("x"))
    return d.select("doc_id", F.md5(T.visible_section(F.col("x")).cast("binary")).alias("digest"))


# A text, a term, and whether the text states the term.
STATED = (
    ("Infiltrative glands are present.", "infiltrat", True),
    ("No infiltrative glands are identified.", "infiltrat", False),
    ("No necrosis. Infiltrative glands", "infiltrat", True),
    ("No necrosis, but infiltrative glands", "infiltrat", True),
    ("No necrosis, infiltrative glands", "infiltrat", False),
    ("not only infiltrative but solid", "infiltrat", True),
    ("infiltrative growth is absent", "infiltrat", False),
    ("non-infiltrative", "infiltrat", False),
    ("noninfiltrative", "infiltrat", False),
    ("未见infiltrative", "infiltrat", False),
    ("infiltrative absent; infiltrative glands present", "infiltrat", True),
    ("adenoglandular infiltrat", "infiltrat", True),
)


# The terms of the evidence policy, by rule and feature group.
POLICY = {
    "growth_infiltrative_glandular": [["infiltrat"], ["gland", "glandular"]],
    "growth_solid_pseudopapillary": [["solid growth", "solid pattern"], ["pseudopapill", "pseudo-papill"]],
    "growth_cribriform_intraductal": [["cribriform"], ["intraductal"]],
    "growth_acinar": [["acinar", "acini"], ["growth", "architecture"]],
    "morph_intermediate_differentiation": [["gland", "glandular"], ["nuclear atypia", "pleomorphism"], ["mitotic", "mitoses"]],
    "morph_intermediate_low_differentiation": [["gland", "glandular"], ["nuclear atypia", "pleomorphism"], ["mitotic", "mitoses"], ["necrosis", "necrotic"]],
}
TERMS = list(dict.fromkeys(t for groups in POLICY.values() for group in groups for t in group))
# How a term is spoken of, and whether that states it.
SAID = (("{} is present.", True), ("No {} is identified.", False), ("Not only {} but more.", True), ("{} growth is absent.", False), ("Without doubt; {} here.", True), ("Free of debris, {} and so on.", False), ("No debris, but {} here.", True))
_GROUPS = [(r, i, group) for r, groups in POLICY.items() for i, group in enumerate(groups)]
_SPOKEN = f"""spoken AS (SELECT doc_id, unnest([{', '.join(map(repr, TERMS))}]) AS term, [{', '.join(str(w).lower() for _, w in SAID)}][1 + (doc_id + unnest(generate_series(0, {len(TERMS) - 1}))) % {len(SAID)}] AS stated FROM documents),
    found AS (SELECT DISTINCT s.doc_id, t.term FROM spoken AS s JOIN (SELECT DISTINCT term FROM spoken) AS t ON s.stated AND contains(s.term, t.term))"""


def _spoken(spark, sf_dir):
    """Every whole document followed by a claim on each term of the policy; one that is part of another is claimed with it."""
    claims = []
    for i, term in enumerate(TERMS):
        said = F.element_at(F.array(*(F.lit(s.format(term)) for s, _ in SAID)), ((F.col("doc_id") + i) % len(SAID) + 1).cast("int"))
        claims.append(said)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), *claims).alias("x"))


@query(f"""WITH {_SPOKEN} SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY term), '') AS stated FROM documents AS d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id""")
def positive_terms(spark, sf_dir):
    """The terms of the whole policy that each document states."""
    terms = F.array(*map(F.lit, TERMS))
    found = F.transform(stated_terms(F.col("x"), TERMS), lambda i: F.element_at(terms, i + 1))
    return _spoken(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(found), "|").alias("stated"))


@query(f"""WITH {_SPOKEN}, owners AS (SELECT * FROM (VALUES {', '.join(f"({r!r}, {i}, {t!r})" for r, i, group in _GROUPS for t in group)}) AS v(rule, grp, term)),
    met AS (SELECT DISTINCT doc_id, rule, grp FROM found JOIN owners USING (term))
    SELECT doc_id, rule, string_agg(grp::VARCHAR, ',' ORDER BY grp) AS groups FROM met GROUP BY doc_id, rule""")
def policy_groups(spark, sf_dir):
    """The feature groups of every rule of the policy that each document matches, by rules as rows."""
    text = _spoken(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("patch_id"), F.col("x").alias("text"), F.lit(True).alias("clean"), F.lit(5).alias("magnification"), *(F.lit(0).cast("long").alias(c) for c in "xywh"))
    found = contract.tile_matches(text, ["doc_id"], contract.rule_rows(spark, {r: {"feature_groups": g} for r, g in POLICY.items()}))
    return found.select("doc_id", "rule", F.array_join("groups", ",").alias("groups"))


_RULE = {"feature_groups": [["infiltrat"], ["gland", "glandular"]], "minimum_feature_groups_per_patch": 1, "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0, 1]}
_CHOICES = {"both": ("infiltrat", "gland"), "solid": ("solid growth", "nest")}
_FINDINGS = ("Infiltrative glands.", "Glandular pattern, no necrosis.", "Solid growth without nests.", "Nothing else.")
_TILES = """tiles AS (SELECT source, doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS clean, doc_id % 4 AS f, right('000000000000' || doc_id, 12) AS id
    FROM documents LEFT JOIN labels USING (doc_id))"""


def _tiles(spark, sf_dir):
    finding = F.element_at(F.array(*map(F.lit, _FINDINGS)), (F.col("doc_id") % 4 + 1).cast("int"))
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    d = joins.with_flag(table(spark, sf_dir, "documents").select("doc_id", "source"), good, ["doc_id"], "clean")
    return d.select(
        "source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("patch_id"), F.concat(F.lit("VISIBLE: "), finding, F.lit("\nABSENT_OR_NOT_SEEN: none")).alias("text"),
        "clean", F.lit(5).alias("magnification"), (F.col("doc_id") * 100).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(50).cast("long").alias("w"), F.lit(50).cast("long").alias("h"),
    )


_BOTH = f"""{_TILES}, m AS (SELECT *, CASE f WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM tiles WHERE clean = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, id) AS r FROM m WHERE n >= 1),
    g AS (SELECT source, count(*) FILTER (r <= 4) AS k, string_agg(id, ',' ORDER BY r) FILTER (r <= 4) AS ids, coalesce(bool_or(f = 0) FILTER (r <= 4), false) AS g0, coalesce(bool_or(r <= 4), false) AS g1 FROM p GROUP BY source),
    both_ AS (SELECT s.source, coalesce(k, 0) AS k, coalesce(ids, '') AS ids, coalesce(g0, false) AS g0, coalesce(g1, false) AS g1 FROM (SELECT DISTINCT source FROM tiles) AS s LEFT JOIN g USING (source))"""


@query(f"""WITH {_BOTH} SELECT source, k >= 2 AND g0 AND g1 AS eligible, round((least(k / 2.0, 1) + (g0::INT + g1::INT) / 2.0 + 1.0) / 3.0, 6)::DOUBLE AS support_score, ids AS selected,
    concat_ws(',', CASE WHEN k < 2 THEN 'clean_nonoverlapping_patch_count_lt_2' END, CASE WHEN NOT (g0 AND g1) THEN 'required_visual_feature_group_missing' END) AS reasons FROM both_""")
def contract_support(spark, sf_dir):
    out = contract.visual_contract(_tiles(spark, sf_dir), ["source"], _RULE)
    return out.select("source", "eligible", "support_score", F.array_join("selected", ",").alias("selected"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_BOTH}, s AS (SELECT source, count(*) FILTER (clean = 1 AND f = 2) >= 2 AS ok FROM tiles GROUP BY source)
    SELECT source, concat_ws(',', CASE WHEN k >= 2 AND g0 AND g1 THEN 'both' END, CASE WHEN ok THEN 'solid' END) AS passing,
        CASE WHEN (k >= 2 AND g0 AND g1) AND NOT ok THEN 'both' WHEN ok AND NOT (k >= 2 AND g0 AND g1) THEN 'solid' END AS answer FROM both_ JOIN s USING (source)""")
def contract_unique_answer(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    solid = {"feature_groups": [["solid growth"]], "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0]}
    each = contract.visual_contracts(tiles, ["source"], {"both": _RULE, "solid": solid})
    out = contract.unique_answer(each.withColumnRenamed("rule", "choice"), ["source"])
    return out.select("source", F.array_join("passing", ",").alias("passing"), "answer")


@query(f"""WITH {_TILES} SELECT doc_id, CASE f WHEN 0 THEN '0,1' WHEN 1 THEN '1' ELSE '' END AS groups FROM tiles""")
def feature_groups(spark, sf_dir):
    from tessella.functions.negation import matching_groups

    t = _tiles(spark, sf_dir)
    found = F.array_join(matching_groups(T.visible_section(F.col("text")), _RULE["feature_groups"]), ",")
    return t.select(F.col("patch_id").cast("long").alias("doc_id"), found.alias("groups"))


_WORDS = r"regexp_split_to_array(coalesce(text, ''), ' ')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), r AS (SELECT conv_id, turn, w AS refs, list_filter(w, lambda x, i: i % 3 <> 0) AS visible FROM w)
    SELECT conv_id, turn, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i AND list_contains(visible, x)), '|') AS valid,
        array_to_string(list_filter(refs, lambda x: NOT list_contains(visible, x)), '|') AS invalid, len(visible) > 0 AND len(list_filter(refs, lambda x: NOT list_contains(visible, x))) = 0 AS all_valid FROM r""")
def citation_partition(spark, sf_dir):
    """Words as refs; two of three places are visible."""
    refs = F.split(F.coalesce("text", F.lit("")), " ", -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", refs.alias("refs"))
    c = c.withColumn("visible", F.filter("refs", lambda x, i: (i + 1) % 3 != 0)).withColumn("c", contract.citations(F.col("refs"), F.col("visible")))
    return c.select("conv_id", "turn", F.array_join("c.valid", "|").alias("valid"), F.array_join("c.invalid", "|").alias("invalid"), "c.all_valid")


_ABC = "['A', 'B', 'C', 'D', 'E']"


@query(f"""WITH v AS (SELECT event_id, [{_ABC}[1 + event_id % 5], {_ABC}[1 + event_id // 5 % 5], {_ABC}[1 + event_id // 25 % 5], {_ABC}[1 + event_id // 125 % 5]] AS v, {_ABC}[1 + user_id % 4] AS c FROM events)
    SELECT event_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i AND x <> 'E' AND x <> c)[1:3], '') AS ranked FROM v""")
def ranked_differential(spark, sf_dir):
    letters = F.array(*map(F.lit, "ABCDE"))
    at = lambda x: F.element_at(letters, (x % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    values = F.array(*(at(F.floor(F.col("event_id") / 5**i)) for i in range(4)))
    choices, candidate = F.slice(letters, 1, 4), F.element_at(letters, (F.col("user_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.array_join(contract.differential(values, choices, candidate, 3), "").alias("ranked"))


@query("""SELECT p_partkey, c.pos - 1 AS position, c.choice FROM (SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_name || '| |' || p_brand || '|' || p_type, '|'), lambda x: trim(x)), lambda x: x <> '')) AS choice,
    unnest(generate_series(1, len(list_filter(list_transform(string_split(p_name || '| |' || p_brand || '|' || p_type, '|'), lambda x: trim(x)), lambda x: x <> '')))) AS pos FROM part) AS c""")
def choice_explode(spark, sf_dir):
    text = F.concat_ws("|", "p_name", F.lit(" "), "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.parse_choices(text)).alias("position", "choice")).withColumn("position", F.col("position").cast("long"))


@query(rf"""WITH d AS (SELECT source, doc_id, '[' || doc_id || ' | Level0=(' || doc_id * 7 || ',' || doc_id * 3 || ') | Magnification=5x | FOV=' || printf('%.1f', doc_id * 0.5::DOUBLE) || 'x' || printf('%.1f', doc_id * 0.1::DOUBLE) || 'um] ' || {_TEXT} AS line
        FROM documents WHERE regexp_matches({_TEXT}, '[^ ]'))
    SELECT source, count(*) AS n, md5(string_agg(line, chr(10) || chr(10) ORDER BY doc_id)) AS digest, length(string_agg(line, chr(10) || chr(10) ORDER BY doc_id)) <= 120000 AS within_limit FROM d GROUP BY source""")
def evidence_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    i = F.col("doc_id")
    line = evidence.tile_line(i.cast("string"), i * 7, i * 3, F.lit(5), i * 0.5, i * 0.1, F.col("text"))
    out = evidence.ordered_join(d, ["source"], ["doc_id"], line, "\n\n", "evidence")
    return out.select("source", "n", F.md5(F.col("evidence").cast("binary")).alias("digest"), evidence.within(F.col("evidence"), 120_000).alias("within_limit"))


@query("""WITH d AS (SELECT source, doc_id, CASE WHEN count(*) OVER (PARTITION BY source) > 50 THEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 ELSE 0 END AS chunk FROM documents)
    SELECT source, chunk, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM d GROUP BY source, chunk""")
def chunk_summary(spark, sf_dir):
    c = evidence.chunks(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    out = evidence.ordered_join(c, ["source", "chunk"], ["doc_id"], F.col("doc_id").cast("string"), ",", "docs")
    return out.select("source", "chunk", "n", "docs")


@query("""SELECT item_id, r AS rollout, CASE WHEN r = 0 THEN 0.0 ELSE 0.7 END::DOUBLE AS temperature, CASE WHEN r = 0 THEN 1.0 ELSE 0.95 END::DOUBLE AS top_p, 11 + r AS seed
    FROM benchmark, generate_series(0, 3) AS g(r)""")
def rollout_sampling(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("rollout"))
    return b.withColumn("s", sampling(F.col("rollout"), seed=11)).select("item_id", "rollout", "s.temperature", "s.top_p", "s.seed")


# Parts of replies; each event has one of each, so that sound and unsound parts meet.
_REPLY = {
    "prov": (4, 1, ['"provisional_recommendation":"B"', '"provisional_recommendation":"Z"', '"provisional_recommendation":null,"benchmark_answer":"C"', '"provisional_recommendation":5']),
    "ranked": (5, 4, ['"ranked_differential":["A","B","x","A","C"]', '"ranked_differential":["A"]', '"ranked_differential":"A"', '"ranked_differential":null', '"ranked_differential":[1,"D",null]']),
    "enough": (4, 3, ['"evidence_sufficient":true', '"evidence_sufficient":false', '"evidence_sufficient":"true"', '"evidence_sufficient":1']),
    "act": (7, 5, ['"next_action":{"type":" Answer "}', '"next_action":"retrieve"', '"next_action":{"type":"zoom","query":" look ","magnification":15,"target_patches":["t1",2,"t2"]}', '"next_action":{"type":"abstain"}', '"next_action":{"type":"dance"}', '"next_action":7', '"next_action":{"type":"inspect","target_patches":"t"}']),
    "stop": (3, 7, ['"abstain_recommended":true', '"abstain_recommended":"true"', '"unsupported_answer_reason":" why "']),
    "state": (2, 1, ['"advisory_evidence_state":{"candidate_evidence_found":true,"ready_for_pathologist_review":"true"}', '"advisory_evidence_state":[]']),
    "lacks": (3, 2, ['"missing_evidence":"necrosis"', '"missing_evidence":""', '"missing_evidence":null']),
    "refs": (3, 11, ['"evidence_refs":["t1","t2"]', '"evidence_refs":"t1"', '"evidence_refs":[]']),
}
_PICKED = " || ',' || ".join(f"[{', '.join(repr(x) for x in parts)}][1 + (event_id // {step}) % {n}]" for n, step, parts in _REPLY.values())


def _replies(spark, sf_dir):
    """Each event as a reply: JSON, JSON in other text, or none."""
    i = F.col("event_id")
    picked = [F.element_at(F.array(*map(F.lit, parts)), (F.floor(i / step) % n + 1).cast("int")) for n, step, parts in _REPLY.values()]
    body = F.concat(F.lit("{"), F.concat_ws(",", *picked), F.lit("}"))
    raw = F.when(i % 13 == 0, F.lit("{")).when(i % 13 == 1, F.concat(F.lit("Decision: "), body, F.lit(" end { "))).when(i % 13 == 2, F.lit("[1]")).otherwise(body)
    asked = F.when(i % 11 == 0, "What is the size of the primary invasive carcinoma?").otherwise("Which structure is seen?")
    return table(spark, sf_dir, "events").select(i, raw.alias("raw"), F.array(*map(F.lit, "ABCD")).alias("choices"), asked.alias("question"))


_PARSED = f"""body AS (SELECT event_id, '{{' || {_PICKED} || '}}' AS b FROM events),
    raws AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN '{{' WHEN 1 THEN 'Decision: ' || b || ' end {{ ' WHEN 2 THEN '[1]' ELSE b END AS raw FROM body),
    tried AS (SELECT *, CASE WHEN json_valid(raw) THEN raw ELSE nullif(regexp_extract(raw, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}'), '') END AS t FROM raws),
    j AS (SELECT event_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t::JSON END AS j FROM tried)"""


@query(f"""WITH {_PARSED},
    a AS (SELECT *, CASE WHEN coalesce(json_type(j, '$.provisional_recommendation'), 'NULL') <> 'NULL' THEN CASE WHEN json_type(j, '$.provisional_recommendation') = 'VARCHAR' THEN j ->> '$.provisional_recommendation' END
            WHEN json_type(j, '$.benchmark_answer') = 'VARCHAR' THEN j ->> '$.benchmark_answer' END AS said,
        coalesce(json_type(j, '$.evidence_sufficient') = 'BOOLEAN' AND (j ->> '$.evidence_sufficient') = 'true', false) AS enough,
        lower(trim(coalesce(CASE json_type(j, '$.next_action') WHEN 'OBJECT' THEN j ->> '$.next_action.type' WHEN 'VARCHAR' THEN j ->> '$.next_action' END, ''))) AS kind,
        CASE WHEN json_type(j, '$.ranked_differential') = 'ARRAY' THEN list_transform(json_extract(j, '$.ranked_differential[*]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END) ELSE []::VARCHAR[] END AS listed FROM j),
    b AS (SELECT *, coalesce(list_contains(['A', 'B', 'C', 'D'], said), false) AS known, kind IN ('answer', 'retrieve', 'inspect', 'zoom', 'abstain') AS legal FROM a),
    c AS (SELECT *, CASE WHEN known THEN said ELSE 'A' END AS answer, CASE WHEN j IS NULL THEN 'abstain' WHEN legal THEN kind WHEN enough THEN 'answer' ELSE 'abstain' END AS asked FROM b),
    d AS (SELECT *, list_filter(listed, lambda x, i: x IS NOT NULL AND list_contains(['A', 'B', 'C', 'D'], x) AND x <> answer AND list_position(listed, x) = i) AS good,
        asked = 'answer' AND NOT enough AS unsupported, asked IN ('retrieve', 'inspect', 'zoom') AND NOT enough AND event_id % 11 = 0 AS report FROM c),
    e AS (SELECT *, CASE WHEN unsupported OR report THEN 'abstain' ELSE asked END AS action, trim(coalesce(j ->> '$.unsupported_answer_reason', '')) AS why,
        concat_ws(',', CASE WHEN json_type(j, '$.ranked_differential') NOT IN ('NULL', 'ARRAY') THEN 'invalid_ranked_differential_changed_to_empty' END, CASE WHEN len(listed) > len(good) THEN 'invalid_ranked_differential_entries_removed' END,
            CASE WHEN unsupported THEN 'unsupported_answer_changed_to_abstain' END, CASE WHEN report THEN 'report_only_search_changed_to_abstain' END) AS repairs FROM d)
    SELECT event_id, answer, array_to_string(good[1:3], '') AS differential, action, enough AND action <> 'abstain' AS sufficient,
        action = 'abstain' OR coalesce(json_type(j, '$.abstain_recommended') = 'BOOLEAN' AND (j ->> '$.abstain_recommended') = 'true', false) AS abstain_recommended,
        CASE WHEN j IS NULL THEN '{decisions.UNPARSED_REASON}' WHEN report AND why = '' THEN '{decisions.REPORT_ONLY_REASON}' ELSE why END AS reason,
        coalesce(json_type(j, '$.advisory_evidence_state.candidate_evidence_found') = 'BOOLEAN', false) AS found, false AS ready, enough AS strict,
        CASE WHEN j IS NULL THEN '{decisions.UNPARSED_MISSING}' ELSE trim(coalesce(nullif(CASE WHEN json_type(j, '$.next_action') = 'OBJECT' THEN j ->> '$.next_action.query' END, ''), j ->> '$.missing_evidence', '')) END AS query,
        CASE WHEN json_type(j, '$.next_action.target_patches') = 'ARRAY' THEN 't1,t2' ELSE '' END AS targets, CASE WHEN json_type(j, '$.next_action') = 'OBJECT' THEN j ->> '$.next_action.magnification' END AS magnification,
        CASE WHEN json_type(j, '$.evidence_refs') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.evidence_refs[*]'), lambda x: x ->> '$'), ',') ELSE '' END AS refs, repairs,
        CASE WHEN NOT (j IS NOT NULL AND known AND legal) THEN 'invalid_action_json' WHEN repairs <> '' THEN 'normalized_action_json' ELSE 'valid_action_json' END AS parse_status FROM e""")
def decision_normalize(spark, sf_dir):
    """A reply of the model made from each event, checked and repaired."""
    out, joined = decisions.normalize(_replies(spark, sf_dir)), lambda c, by=",": F.array_join(c, by).alias(c)
    return out.select(
        "event_id", "answer", joined("differential", ""), "action", "sufficient", "abstain_recommended", F.col("unsupported_reason").alias("reason"), F.col("advisory.candidate_evidence_found").alias("found"), "advisory.ready", "advisory.strict",
        "query", joined("targets"), "magnification", joined("refs"), joined("repairs"), "parse_status",
    )


@query(f"""WITH {_PARSED}, a AS (SELECT *, lower(trim(coalesce(CASE json_type(j, '$.next_action') WHEN 'OBJECT' THEN j ->> '$.next_action.type' WHEN 'VARCHAR' THEN j ->> '$.next_action' END, ''))) AS kind FROM j),
    b AS (SELECT *, kind IN ('answer', 'retrieve', 'inspect', 'zoom', 'abstain') AS legal FROM a)
    SELECT event_id, CASE WHEN j IS NULL THEN 'Insufficient evidence' END AS answer, CASE WHEN j IS NULL THEN 'abstain' WHEN legal THEN kind ELSE 'abstain' END AS action,
        CASE WHEN j IS NULL THEN '{decisions.UNPARSED_MISSING}' ELSE trim(coalesce(nullif(CASE WHEN json_type(j, '$.next_action') = 'OBJECT' THEN j ->> '$.next_action.query' END, ''), j ->> '$.missing_evidence', '')) END AS query,
        CASE WHEN json_type(j, '$.evidence_refs') = 'ARRAY' THEN len(json_extract(j, '$.evidence_refs[*]')) ELSE 0 END::BIGINT AS n_refs,
        CASE WHEN coalesce(legal, false) AND j IS NOT NULL THEN 'valid_action_json' ELSE 'invalid_action_json' END AS parse_status FROM b""")
def domain_decisions(spark, sf_dir):
    """The same replies by the rules of the domain protocol."""
    out = decisions.normalize_domain(_replies(spark, sf_dir))
    return out.select("event_id", "answer", "action", "query", F.size("refs").cast("long").alias("n_refs"), "parse_status")


_RAWS = ['x {"answer":"zzz","explanation":" why "}', '{"answer":"view"} then {"a":1}', '{"answer":["view","nope","click"],"evidence_refs":["a",5]}', '{"answer":"view", "why": "cut', "{", '{"answer":"search","confidence":0.5}', '{"answer":" click ", "x": {"y":1}} ', "", '{"answer":"click"} {broken}']


@query(f"""WITH r AS (SELECT event_id, event_id % 7 < 3 AS multiple, ['view', 'Insufficient evidence', 'click'] AS c, [{", ".join(repr(x) for x in _RAWS)}][1 + event_id % {len(_RAWS)}] AS raw FROM events),
    k AS (SELECT *, list_filter(regexp_extract_all(raw, '(?s)\\{{.*?\\}}'), lambda x: json_valid(x))[-1]::JSON AS j, trim(regexp_extract(raw, '"answer"\\s*:\\s*"([^"]+)"', 1)) AS exact FROM r),
    f AS (SELECT *, trim(coalesce(j ->> '$.answer', '')) AS said, CASE WHEN list_contains(c, exact) THEN exact END AS recovered FROM k)
    SELECT event_id, CASE WHEN j IS NULL THEN coalesce(recovered, 'Insufficient evidence')
            WHEN multiple THEN array_to_string(list_filter(CASE json_type(j, '$.answer') WHEN 'ARRAY' THEN list_transform(json_extract(j, '$.answer[*]'), lambda x: x ->> '$') ELSE [j ->> '$.answer'] END, lambda x: coalesce(list_contains(c, x), false)), '|')
            WHEN list_contains(c, said) THEN said ELSE 'Insufficient evidence' END AS answer,
        CASE WHEN j IS NOT NULL THEN coalesce(nullif(trim(coalesce(j ->> '$.explanation', '')), ''), '{decisions.UNEXPLAINED}') WHEN recovered IS NOT NULL THEN '{decisions.RECOVERED}' ELSE '{decisions.UNRECOVERED}' END AS explanation,
        CASE WHEN json_type(j, '$.evidence_refs') = 'ARRAY' THEN 'a' ELSE '' END AS refs, CASE WHEN j IS NULL THEN 0.0::DOUBLE ELSE (j ->> '$.confidence')::DOUBLE END AS confidence,
        CASE WHEN j IS NOT NULL THEN 'valid_json' WHEN recovered IS NOT NULL THEN 'recovered_exact_choice' ELSE 'safe_fallback' END AS status FROM f""")
def final_answers(spark, sf_dir):
    """Replies of every form for single and multiple choice."""
    i = F.col("event_id")
    raw = F.element_at(F.array(*map(F.lit, _RAWS)), (i % len(_RAWS) + 1).cast("int"))
    choices = F.array(F.lit("view"), F.lit("Insufficient evidence"), F.lit("click"))
    found = table(spark, sf_dir, "events").select(i, decisions.final_answer(raw, choices, i % 7 < 3).alias("f"))
    return found.select("event_id", F.array_join("f.answer", "|").alias("answer"), "f.explanation", F.array_join("f.refs", ",").alias("refs"), "f.confidence", "f.status")


@query("""SELECT doc_id, sha256('{"document":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || CASE WHEN source IS NULL THEN '' ELSE ',"source":"' || source || '"' END || '}') AS cache_key,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'known' END AS cached FROM documents""")
def description_cache(spark, sf_dir):
    """Cache keys of requests; the labelled documents are known."""
    fields = {"source": F.col("source"), "document": F.col("doc_id"), "lang": F.col("lang")}
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("cache_key", calls.cache_key(fields))
    known = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("cache_key", F.lit("known").alias("reply"))
    return calls.with_cache(d, known).select("doc_id", "cache_key", "cached")


@query("""SELECT source, avg((r + g + b >= 720 AND s <= 15)::INT::DOUBLE) AS white FROM (SELECT *, CASE WHEN greatest(r, g, b) > 0 THEN floor((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b)) ELSE 0 END AS s
    FROM (SELECT user_id AS source, 230 + event_id % 26 AS r, 235 + event_id * 7 % 21 AS g, 228 + event_id * 3 % 28 AS b FROM events)) GROUP BY source""")
def white_fraction(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), (230 + i % 26).alias("r"), (235 + i * 7 % 21).alias("g"), (228 + i * 3 % 28).alias("b"))
    return e.groupBy("source").agg(pixels.white_fraction(F.col("r"), F.col("g"), F.col("b")).alias("white"))


@query(f"""WITH {_TILES}, v AS (SELECT * FROM tiles), c AS (SELECT source, count(*) FILTER (clean = 1 AND f = 0) AS n0, count(*) FILTER (clean = 1 AND f = 2) AS n2 FROM v WHERE doc_id % 2 = 0 GROUP BY source),
    a AS (SELECT source, count(*) FILTER (clean = 1 AND f = 0) AS v0, count(*) FILTER (clean = 1 AND f = 2) AS v2 FROM v GROUP BY source),
    j AS (SELECT a.source AS s, coalesce(n0, 0) >= 2 AS c0, coalesce(n2, 0) >= 2 AS c2, v0 >= 2 AS p0, v2 >= 2 AS p2, coalesce(n0, 0) > 0 AS d0, coalesce(n0, 0) + coalesce(n2, 0) > 0 AS any_match, c.source IS NOT NULL AS cited FROM a LEFT JOIN c ON a.source = c.source)
    SELECT s AS question_id, cited AS citation_valid, p0 OR p2 AS evidence_found, cited AND c0 AND NOT c2 AND p0 AND NOT p2 AS strict, cited AND any_match AS candidate_evidence_found, cited AND (d0 OR any_match) AS ready,
        concat_ws('|', CASE WHEN p0 THEN 'glandular' END, CASE WHEN p2 THEN 'solid' END) AS visible_passing, concat_ws('|', CASE WHEN c0 THEN 'glandular' END, CASE WHEN c2 THEN 'solid' END) AS cited_passing FROM j""")
def evidence_state(spark, sf_dir):
    """Each source is a question on all its documents; the even documents are cited."""
    tiles = _tiles(spark, sf_dir).withColumnRenamed("source", "question_id")
    visible = tiles.groupBy("question_id").agg(F.array_sort(F.collect_list("patch_id")).alias("visible"))
    q = visible.withColumns({
        "question_type": F.lit("structure"), "choices": F.array(F.lit("glandular"), F.lit("solid")), "candidate": F.lit("glandular"), "tier": F.lit("strict"),
        "refs": F.filter("visible", lambda p: p.cast("long") % 2 == 0), "ranked": F.array(F.lit("solid")),
    })
    concepts = spark.createDataFrame([("structure", "c0", "glandular"), ("structure", "c1", "solid")], "question_type string, concept string, display string")
    none = spark.createDataFrame([], "concept string, support string, needs_zoom boolean")
    rules = {"c0": _RULE | {"minimum_feature_groups_per_patch": 2}, "c1": {"feature_groups": [["solid growth"]], "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0]}}
    out = review.evaluate(q, tiles, concepts, none, rules)
    return out.select("question_id", "citation_valid", "evidence_found", "strict", "candidate_evidence_found", "ready", F.array_join("visible_passing", "|").alias("visible_passing"), F.array_join("cited_passing", "|").alias("cited_passing"))


_N_RULES = 50
_FINDING = "'Finding ' || right('0' || (doc_id % 50), 2) || ' is ' || CASE WHEN doc_id % 7 = 0 THEN 'absent.' ELSE 'present.' END"


@query(f"""WITH tiles AS (SELECT source, doc_id, coalesce(quality = 1 AND toxic = 0, false) AS clean, doc_id % 50 AS f, doc_id % 7 <> 0 AS stated, doc_id % 2 = 0 AS cited FROM documents LEFT JOIN labels USING (doc_id)),
    fits AS (SELECT * FROM tiles WHERE clean AND stated),
    per AS (SELECT source, f, count(*) AS v, count(*) FILTER (cited) AS c FROM fits GROUP BY source, f),
    q AS (SELECT source, count(*) FILTER (cited) > 0 AS valid FROM tiles GROUP BY source),
    s AS (SELECT q.source, valid, coalesce(count(f) FILTER (v >= 2), 0) AS n_visible, coalesce(count(f) FILTER (c >= 2), 0) AS n_cited, coalesce(bool_or(f = 2 AND v >= 2), false) AS own_v, coalesce(bool_or(f = 2 AND c >= 2), false) AS own_c,
        least(coalesce(max(v) FILTER (f = 2), 0), 2) AS v2, least(coalesce(max(c) FILTER (f = 2), 0), 2) AS c2, coalesce(sum(c), 0)::BIGINT AS matched, coalesce(max(c) FILTER (f = 2), 0) AS mine, coalesce(max(c) FILTER (f = 4), 0) AS other
        FROM q LEFT JOIN per USING (source) GROUP BY q.source, valid)
    SELECT source AS question_id, n_visible, n_cited, valid AND own_v AND own_c AND n_visible = 1 AND n_cited = 1 AS strict, valid AND matched > 0 AS found, CASE WHEN valid THEN matched ELSE 0 END AS n_records,
        CASE WHEN valid THEN mine + other ELSE 0 END AS n_supporting,
        round((v2 / 2.0 + (v2 > 0)::INT + 1.0) / 3.0, 6)::DOUBLE AS support_score,
        concat_ws('|', CASE WHEN NOT valid THEN 'valid_visible_citation_required' END, CASE WHEN NOT (valid AND matched > 0) THEN 'clean_localizable_cited_patch_matching_an_allowed_feature_group_required' END,
            CASE WHEN NOT (valid AND mine + other > 0) THEN 'direct_support_for_provisional_or_ranked_differential_required' END,
            CASE WHEN v2 < 2 THEN 'visible:clean_nonoverlapping_patch_count_lt_2' END, CASE WHEN v2 = 0 THEN 'visible:required_visual_feature_group_missing' END,
            CASE WHEN c2 < 2 THEN 'cited:clean_nonoverlapping_patch_count_lt_2' END, CASE WHEN c2 = 0 THEN 'cited:required_visual_feature_group_missing' END,
            CASE WHEN NOT (valid AND own_v AND own_c AND n_visible = 1 AND n_cited = 1) THEN 'strict_contract_not_satisfied' END) AS missing FROM s""")
def evidence_rules(spark, sf_dir):
    """Each source is a question with fifty choices, each with a rule of its own; the even documents are cited."""
    i = F.col("doc_id")
    state = F.when(i % 7 == 0, "absent.").otherwise("present.")
    said = F.concat(F.lit("Finding "), F.lpad((i % _N_RULES).cast("string"), 2, "0"), F.lit(" is "), state)
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    d = joins.with_flag(table(spark, sf_dir, "documents").select("doc_id", "source"), good, ["doc_id"], "clean")
    tiles = d.select(F.col("source").alias("question_id"), i.cast("string").alias("patch_id"), said.alias("text"), F.col("clean"), F.lit(5).alias("magnification"), (i * 100).alias("x"), *(F.lit(50).cast("long").alias(c) for c in "ywh"))
    names = [f"choice {n:02d}" for n in range(_N_RULES)]
    q = tiles.groupBy("question_id").agg(F.array_sort(F.collect_list("patch_id")).alias("visible")).withColumns({
        "question_type": F.lit("structure"), "choices": F.array(*map(F.lit, names)), "candidate": F.lit(names[2]), "tier": F.lit("strict"),
        "refs": F.filter("visible", lambda p: p.cast("long") % 2 == 0), "ranked": F.array(F.lit(names[4])),
    })
    concepts = spark.createDataFrame([("structure", f"c{n}", name) for n, name in enumerate(names)], "question_type string, concept string, display string")
    none = spark.createDataFrame([], "concept string, support string, needs_zoom boolean")
    rules = {f"c{n}": {"feature_groups": [[f"finding {n:02d}"]], "minimum_clean_evidence_patches": 2, "required_anywhere_groups": [0]} for n in range(_N_RULES)}
    out = review.evaluate(q, tiles, concepts, none, rules)
    records = review.match_records(review.cited_matches(q, tiles, concepts, none, rules)).groupBy("question_id").agg(F.count("*").alias("n_records"))
    out = out.join(records, "question_id", "left")
    return out.select(
        "question_id", F.size("visible_passing").cast("long").alias("n_visible"), F.size("cited_passing").cast("long").alias("n_cited"), "strict", F.col("candidate_evidence_found").alias("found"),
        F.when(F.col("citation_valid"), F.coalesce("n_records", F.lit(0))).otherwise(0).cast("long").alias("n_records"), F.size("supporting").cast("long").alias("n_supporting"), "support_score", F.array_join("missing", "|").alias("missing"),
    )
