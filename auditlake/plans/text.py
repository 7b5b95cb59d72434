"""Text, date and keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.functions.binding import unpack
from auditlake.operators import brand as B, keywords as K, site_rules
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources.tables import AS_OF, AS_OF_EPOCH, table

u = F.col
_STOP = ", ".join(D.lit(w) for w in X.STOPWORDS)
_WORDS = "[w FOR w IN regexp_extract_all(lower({x}), '[a-záéíóúüñàèìòù0-9]{{3,}}') IF w NOT IN (" + _STOP + ") AND strip_accents(w) NOT IN (" + _STOP + ") AND NOT regexp_full_match(w, '[0-9]+')]"

D.CTES["keyword_fields"] = f"""
SELECT page_id, 0 AS field, 4 AS weight, {_WORDS.format(x='title')} AS words FROM facts
UNION ALL SELECT page_id, n, 3, {_WORDS.format(x='h')} FROM (SELECT page_id, unnest(h1) AS h, generate_subscripts(h1, 1) AS n FROM facts)
UNION ALL SELECT page_id, 1000, 2, {_WORDS.format(x='meta_description')} FROM facts
UNION ALL SELECT page_id, 1001, 1, {_WORDS.format(x='text')} FROM facts
"""
D.CTES["term_scores"] = """
SELECT page_id, term, sum(w)::bigint AS score, row_number() OVER (PARTITION BY page_id ORDER BY min((field, kind, pos))) AS first_no FROM (
  SELECT page_id, field, 0 AS kind, generate_subscripts(words, 1) AS pos, unnest(words) AS term, weight AS w FROM keyword_fields
  UNION ALL SELECT page_id, field, 1, i, words[i] || ' ' || words[i + 1], weight + 1 FROM (SELECT *, unnest(range(1, len(words))) AS i FROM keyword_fields))
GROUP BY page_id, term
"""
# the greedy choice: a word is dropped when it sits in a pair already chosen; walks the 15 best terms in order
D.CTES["page_top"] = """
SELECT page_id, list_reduce(list(term ORDER BY score DESC, first_no), lambda acc, t: CASE WHEN len(acc) >= 5 OR (NOT contains(t[1], ' ') AND len([c FOR c IN acc IF contains(c, ' ') AND list_contains(string_split(c, ' '), t[1])]) > 0) THEN acc ELSE list_concat(acc, t) END, []::varchar[]) AS keywords
FROM (SELECT page_id, [term] AS term, score, first_no FROM term_scores QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, first_no) <= 15) GROUP BY page_id
"""


@query("text_fold", f"SELECT doc_id, {D.fold('text')} AS folded FROM documents")
def text_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold(u("text")).alias("folded"))


@query("keyword_tokens", f"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-záéíóúüñàèìòù0-9]{{3,}}'))::bigint AS n_tokens, array_to_string({_WORDS.format(x='text')}, ' ') AS words FROM documents""")
def keyword_tokens(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", X.word_tokens(u("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join(F.expr(f"filter(tokens, w -> {X.IS_CONTENT_WORD})"), " ").alias("words"))


@query("keyword_scores", "SELECT page_id, term, score FROM term_scores")
def keyword_scores(spark, sf):
    scored = K.scored_terms(I.facts(spark, sf, keep_text=True))
    return unpack(scored.select("page_id", "scored"), "scored", "t").select("page_id", "t.term", "t.score")


@query("page_keywords", "SELECT f.page_id, coalesce(array_to_string(k.keywords, ', '), '') AS keywords FROM facts f LEFT JOIN page_top k ON k.page_id = f.page_id")
def page_keywords(spark, sf):
    return K.top_keywords(I.facts(spark, sf, keep_text=True)).select("page_id", I.text_of("keywords", ", ").alias("keywords"))


D.CTES["site_topics"] = """
SELECT site, rank, keyword, pages FROM (
  SELECT site, keyword, count(*) AS pages, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, min((page_id, pos))) AS rank
  FROM (SELECT f.site, f.page_id, unnest(k.keywords) AS keyword, generate_subscripts(k.keywords, 1) AS pos FROM facts f JOIN page_top k ON k.page_id = f.page_id) GROUP BY site, keyword) WHERE rank <= 6
"""


@query("site_keywords", "SELECT site, rank, keyword, pages FROM site_topics")
def site_keywords(spark, sf):
    """Sites whose pages have no keyword also have no home-page text here, so the fallback adds nothing."""
    return K.site_keywords(_with_keywords(spark, sf))


def _with_keywords(spark, sf):
    pages = K.top_keywords(I.facts(spark, sf, keep_text=True))
    return I.stage(pages.select("page_id", "site", "depth", "title", "h1", "meta_description", "keywords"), "keywords")


@query("visibility_questions", f"""
SELECT site, row_number() OVER (PARTITION BY site ORDER BY rank) AS question_no, '¿Cuáles son los mejores sitios web o marcas para «' || topic || '»? Nombra varios.' AS question FROM (
  SELECT site, rank, trim(array_to_string([w FOR w IN string_split(keyword, ' ') IF {D.fold('w')} NOT IN ({D.fold(f"split_part({D.domain(chr(39) + 'https://' + chr(39) + ' || site')}, '.', 1)")}, {D.fold(D.domain("'https://' || site"))})], ' ')) AS topic FROM site_topics)
WHERE length(topic) >= 3 QUALIFY question_no <= 4""")
def visibility_questions(spark, sf):
    return B.visibility_questions(K.site_keywords(_with_keywords(spark, sf)))


@query("framing_labels", f"""
SELECT resp_id, CASE WHEN contains({D.fold('reply')}, 'positivo') THEN 'positivo' WHEN contains({D.fold('reply')}, 'neutro') THEN 'neutro' WHEN contains({D.fold('reply')}, 'negativo') THEN 'negativo'
  WHEN contains({D.fold('reply')}, 'con_reservas') THEN 'con_reservas' ELSE 'neutro' END AS framing FROM framing_replies""")
def framing_labels(spark, sf):
    return table(spark, sf, "framing_replies").select("resp_id", X.framing_label(u("reply")).alias("framing"))


_AGE = f"({AS_OF_EPOCH} - unix_ts)"


@query("relative_age", f"""
SELECT event_id, CASE WHEN age < 0 THEN 'hace un momento' WHEN age < 3600 THEN 'hace ' || greatest(1, age // 60) || ' min' WHEN age < 86400 THEN CASE WHEN age < 7200 THEN 'hace 1 hora' ELSE 'hace ' || (age // 3600) || ' horas' END
    WHEN age < 172800 THEN 'hace 1 día' ELSE 'hace ' || (age // 86400) || ' días' END AS caption,
  CASE WHEN age < 3600 THEN 'hace ' || greatest(1, age // 60) || ' min' WHEN age < 86400 THEN 'hace ' || (age // 3600) || ' h' ELSE 'hace ' || (age // 86400) || ' d' END AS short
FROM (SELECT event_id, 1706572800 - unix_ts AS age FROM event_log)""")
def relative_age(spark, sf):
    """Ages against a moment inside the log, so that hours, minutes and the future all occur."""
    aged = table(spark, sf, "event_log").withColumn("age", F.lit(1706572800) - u("unix_ts"))
    return aged.select("event_id", X.relative_time(u("age")).alias("caption"), X.short_age(u("age")).alias("short"))


@query("fetch_error_class", f"""
SELECT doc_id, CASE WHEN regexp_matches(m, '{'|'.join(X.DNS_MARKERS)}') THEN 'dns_not_found' WHEN contains(m, 'timed out') OR contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'refused') THEN 'connection_refused'
  WHEN contains(m, 'ssl') OR contains(m, 'certificate') OR contains(m, 'err_cert') OR contains(m, 'tls') THEN 'ssl_error' ELSE 'connection_error' END AS error_type FROM (
  SELECT doc_id, lower(text || CASE doc_id % 6 WHEN 0 THEN ' net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN ' TLS handshake timed out' WHEN 2 THEN ' ERR_CONNECTION_REFUSED' WHEN 3 THEN ' ERR_CERT_DATE_INVALID' WHEN 4 THEN ' NXDOMAIN timeout' ELSE '' END) AS m FROM documents)""")
def fetch_error_class(spark, sf):
    """Whole document texts with a marker appended, as messages."""
    suffix = F.expr("CASE doc_id % 6 WHEN 0 THEN ' net::ERR_NAME_NOT_RESOLVED' WHEN 1 THEN ' TLS handshake timed out' WHEN 2 THEN ' ERR_CONNECTION_REFUSED' WHEN 3 THEN ' ERR_CERT_DATE_INVALID' WHEN 4 THEN ' NXDOMAIN timeout' ELSE '' END")
    return table(spark, sf, "documents").select("doc_id", X.fetch_error_class(F.concat("text", suffix)).alias("error_type"))


@query("retry_plan", """
SELECT event_id, attempt, CASE WHEN regexp_full_match(retry_after, '[0-9]+') THEN retry_after::double ELSE least(1.5 * 2 ^ attempt, 20.0)::double END AS delay FROM (SELECT event_id, retry_after, event_id % 5 AS attempt FROM fetch_log)""")
def retry_plan(spark, sf):
    log = table(spark, sf, "fetch_log").withColumn("attempt", u("event_id") % 5)
    return log.select("event_id", "attempt", X.retry_delay(u("retry_after"), u("attempt")).alias("delay"))


@query("tls_expiry", f"""
SELECT site, CASE WHEN NOT valid THEN '' WHEN organization <> '' THEN organization ELSE common_name END AS issuer, CASE WHEN valid THEN floor((epoch(try_strptime(regexp_replace(replace(not_after, ' GMT', ''), ' +', ' ', 'g'), '%b %d %H:%M:%S %Y')) - {AS_OF_EPOCH}) / 86400)::bigint END AS days_left
FROM certificates""")
def tls_expiry(spark, sf):
    return site_rules.certificate_facts(table(spark, sf, "certificates"), F.lit(AS_OF).cast("timestamp")).select("site", "issuer", "days_left")
