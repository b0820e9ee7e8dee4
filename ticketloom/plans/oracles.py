"""DuckDB SQL twins of the queries, written as brute force over the same tables.

Fragments are named common table expressions; ``_sql`` puts the ones a query
needs, with what they need in turn, in front of it.
"""

from __future__ import annotations

from ticketloom import config
from ticketloom.config import AMAZONHELP, BRANDS
from ticketloom.functions import prompts
from ticketloom.functions import text as X
from ticketloom.sources.tables import LEXICON, RISK_WORDS, TAXONOMIES, TAXONOMY

ORACLES: dict[str, str] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _part(name: str, sql: str, *needs: str) -> None:
    _PARTS[name] = (needs, sql)


def _sql(main: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in _PARTS[name][0]:
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return main
    ctes = ",\n".join(f"{n} as materialized ({_PARTS[n][1]})" for n in ordered)
    return f"with recursive {ctes}\n{main}"


def _oracle(name: str, main: str, *needs: str) -> None:
    ORACLES[name] = _sql(main, *needs)


# ------------------------------------------------------------ text expressions


def _norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _handles(x: str) -> str:
    return f"regexp_replace({x}, '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"


def _email(x: str) -> str:
    return f"regexp_replace({x}, '{X.EMAIL}', '[EMAIL]', 'g')"


def _card(x: str) -> str:
    return f"regexp_replace({x}, '{X.CREDIT_CARD}', '[CREDIT_CARD]', 'g')"


# RE2's \b is ASCII only.  Bracketing every word by two marker characters gives
# Unicode word boundaries.
_ORDER_MARKED = (
    r"\x01\d{3}\x02-\x01\d{7}\x02-\x01\d{7}\x02|\x01\d{17}\x02|\x01[A-Z0-9]{10,12}\x02"
)


def _marked(x: str) -> str:
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"


def _order(x: str) -> str:
    return f"regexp_replace(regexp_replace({_marked(x)}, '{_ORDER_MARKED}', '[ORDER_ID]', 'g'), '[\\x01\\x02]', '', 'g')"


def _phone(x: str) -> str:
    return f"regexp_replace({x}, '{X.PHONE}', '[PHONE]', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sanitize(x: str) -> str:
    return _strip(_phone(_order(_card(_email(x)))))


def _clean(x: str) -> str:
    return _sanitize(_norm(x))


def _any(x: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {_lit(w)})" for w in words) + ")"


def _first(x: str, words) -> str:
    return "case " + " ".join(f"when contains(lower({x}), {_lit(w)}) then {_lit(w)}" for w in words) + " end"


def _rules(x: str, rules, default: str) -> str:
    return "case " + " ".join(f"when {_any(x, ks)} then {_lit(i)}" for i, ks in rules) + f" else {_lit(default)} end"


_WORDS = r"[\p{L}\p{N}_]{2,}"
RULES = tuple((x.id, x.keywords) for x in TAXONOMY if x.keywords)


def _classify(x: str) -> str:
    return _rules(x, RULES, "topic_none")


# --------------------------------------------------------------- shared parts

_part(
    "tweets",
    """
  with f as (select conv_id, min(turn) fu from conversations where role = 'user' group by conv_id)
  select cast(c.conv_id*1000 + c.turn as varchar) tweet_id,
         case when c.role = 'user' then 'u' || (c.conv_id % 17) else 'Brand' || (c.conv_id % 3) end author_id,
         c.role = 'user' inbound,
         '2024-01-' || lpad(cast(1 + c.conv_id % 28 as varchar), 2, '0') || ' 00:'
           || lpad(cast(c.turn*5 as varchar), 2, '0') || ':00' created_at,
         c.text,
         case when c.role = 'assistant' and c.turn >= 3 and c.conv_id % 4 = 0
                then cast(c.conv_id*1000 + f.fu as varchar)
              when c.turn > 0 then cast(c.conv_id*1000 + c.turn - 1 as varchar) end in_response_to_tweet_id
  from conversations c join f on c.conv_id = f.conv_id""",
)
_part(
    "joined",
    """
  select p.tweet_id parent_id, r.tweet_id reply_id, r.author_id brand, p.author_id customer_id
  from tweets r join tweets p on r.in_response_to_tweet_id = p.tweet_id
  where not r.inbound and lower(r.author_id) in ('brand0', 'brand1', 'brand2') and p.inbound""",
    "tweets",
)
def _detected(name: str, source: str, key: str, *needs: str) -> None:
    """The language of each text by the profiles of the documents."""
    _part(
        name,
        f"""
  with t as (select lang, unnest(regexp_extract_all(lower(text), '{_WORDS}')) token from documents),
  c as (select lang, token, count(*) n from t group by lang, token),
  p as (select lang, token, n / cast(sum(n) over (partition by lang) as double) weight from c),
  a as (select {key}, unnest(regexp_extract_all(lower(text), '{_WORDS}')) token from {source}),
  s as (select a.{key}, p.lang, round(sum(weight), 9) score from a join p on a.token = p.token group by a.{key}, p.lang)
  select {key}, lang detected from (select *, row_number() over (partition by {key} order by score desc, lang) i from s)
  where i = 1""",
        *needs,
    )


_detected("detected", "documents", "doc_id")
_detected("tweets_detected", "(select * from tweets where inbound and text <> '')", "tweet_id", "tweets")
_part(
    "threads",
    f"""
  with r as (
    select author_id brand, in_response_to_tweet_id parent_id, tweet_id reply_id, {_clean('text')} agent_reply, created_at
    from tweets where not inbound and lower(author_id) in ('brand0', 'brand1', 'brand2')
      and in_response_to_tweet_id is not null and text <> ''),
  r1 as (select *, row_number() over (partition by brand, parent_id order by cast(reply_id as bigint)) i
         from r where length(agent_reply) >= 10),
  p as (select tweet_id parent_id, author_id, created_at, {_clean('text')} q from tweets
        where inbound and text <> ''
          and (length({_strip('text')}) < 5 or not regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]'))
          and (length({_strip('text')}) < 5 or tweet_id not in (select tweet_id from tweets_detected where detected <> 'en')))
  select 'thread_' || p.parent_id || '_' || r1.reply_id thread_id, r1.brand, p.parent_id customer_tweet_id,
         p.author_id customer_author_id, p.created_at customer_created_at, p.q customer_query,
         r1.reply_id agent_tweet_id, r1.agent_reply, r1.created_at agent_created_at, 2 turn_count
  from r1 join p on r1.parent_id = p.parent_id where r1.i = 1 and length(p.q) >= 10""",
    "tweets",
    "tweets_detected",
)
_part("lexicon", "select * from (values " + ", ".join(f"({_lit(w)}, {v}e0)" for w, v in LEXICON) + ") t(word, valence)")
_part(
    "intents",
    "select * from (values "
    + ", ".join(
        f"({_lit(b)}, {_lit(x.id)}, {_lit(x.name)}, {i}, {str(x.auto_handle_eligible).lower()})"
        for b, own in TAXONOMIES.items()
        for i, x in enumerate(own)
    )
    + ") t(brand, intent_id, name, ord, eligible)",
)
_part(
    "tickets",
    """
  select d.doc_id ticket_id, d.text query, 'Brand' || (d.doc_id % 3) brand,
         case d.doc_id % 6 when 0 then 'topic_thing' when 1 then 'topic_tion' when 2 then 'topic_ble'
                           when 3 then 'topic_er' when 4 then 'topic_abuse' else 'topic_unknown' end predicted_intent,
         0.5e0 + (d.doc_id*37 % 51) / 100e0 confidence, 1 + d.doc_id*7 % 4 turn_count,
         0.4e0 + (d.doc_id*53 % 61) / 100e0 rag_similarity, l.toxic = 1 or l.quality = 0 true_escalate
  from documents d join labels l on d.doc_id = l.doc_id""",
)


def _sentiment(name: str, source: str, key: str, text: str, *needs: str) -> None:
    _part(
        name,
        f"""
  with w as (select {key}, unnest(regexp_extract_all(lower({text}), '{_WORDS}')) token from {source}),
  s as (select {key}, sum(valence) s from w join lexicon on token = word group by {key})
  select t.{key}, coalesce(s / sqrt(s*s + 15), 0e0) sentiment from {source} t left join s on t.{key} = s.{key}""",
        "lexicon",
        *needs,
    )


_sentiment("doc_sentiment", "documents", "doc_id", "text")
_sentiment("ticket_sentiment", "tickets", "ticket_id", "query", "tickets")
_sentiment("thread_sentiment", "threads", "thread_id", "customer_query", "threads")

_part(
    "probs",
    """
  with ex as (select vec_id, label, unnest(range(len(embedding))) i, cast(unnest(embedding) as double) v from embeddings),
  cen as (select label k, i, avg(v) c from ex group by label, i),
  lg as (select e.vec_id, cast(e.label as bigint) y, cast(cen.k as bigint) k, sum(e.v*cen.c) z
         from ex e join cen on e.i = cen.i group by e.vec_id, e.label, cen.k)
  select vec_id, y, k, z, exp(z/0.02e0)/sum(exp(z/0.02e0)) over (partition by vec_id) p from lg""",
)
_part("ranked", "select *, row_number() over (partition by vec_id order by p desc, k) r from probs", "probs")
_part(
    "predictions",
    """select a.vec_id, a.y, a.k pred, a.p confidence, a.k = a.y correct, b.p p_true
  from ranked a join probs b on a.vec_id = b.vec_id and b.k = a.y where a.r = 1""",
    "ranked",
    "probs",
)
_part(
    "sims",
    """
  select a.vec_id q, b.vec_id id,
         list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) score
  from embeddings a join embeddings b on a.vec_id <> b.vec_id""",
)
_part(
    "near",
    """select * from (select *, row_number() over (partition by q order by round(score, 9) desc, id) "rank" from sims)
  where "rank" <= 15""",
    "sims",
)


def _collection(name: str, source: str, key: str, text: str, grp: str = "''", *needs: str) -> None:
    _part(name, f"select {grp} grp, {key} doc, lower({_norm(text)}) text from {source}", *needs)


_collection("docs", "documents", "doc_id", "text")
_collection("items", "benchmark", "item_id", "text")
_collection("passages", "threads", "'passage_' || thread_id", "customer_query", "''", "threads")
_collection("brand_passages", "threads", "'passage_' || thread_id", "customer_query", "brand", "threads")
_collection("brand_tickets", "threads", "thread_id", "customer_query", "brand", "threads")


def _bm25(name: str, queries: str, corpus: str, k: int) -> None:
    """``name``: (grp, q, doc, score, rank) and ``name_terms``: per-term statistics."""
    _part(
        f"{name}_tf",
        f"""
  with t as (select grp, doc, unnest(string_split(text, ' ')) term from {corpus})
  select grp, doc, term, count(*) tf from t where term <> '' group by grp, doc, term""",
        corpus,
    )
    _part(
        f"{name}_size",
        f"""
  select c.grp, count(*) n_docs, sum(coalesce(l.dl, 0)) / cast(count(*) as double) avgdl
  from {corpus} c left join (select grp, doc, sum(tf) dl from {name}_tf group by grp, doc) l
    on c.grp = l.grp and c.doc = l.doc group by c.grp""",
        corpus,
        f"{name}_tf",
    )
    _part(
        f"{name}_terms",
        f"""
  with d as (select grp, term, count(*) df, sum(tf) total_tf from {name}_tf group by grp, term),
  r as (select d.*, n_docs, avgdl, ln(n_docs - df + 0.5e0) - ln(df + 0.5e0) raw from d join {name}_size s on d.grp = s.grp),
  m as (select grp, avg(raw) mean from r group by grp)
  select r.*, case when raw < 0 then 0.25e0 * mean else raw end idf from r join m on r.grp = m.grp""",
        f"{name}_tf",
        f"{name}_size",
    )
    _part(
        name,
        f"""
  with qt as (select grp, doc q, term, count(*) qtf
              from (select grp, doc, unnest(string_split(text, ' ')) term from {queries}) where term <> ''
              group by grp, doc, term),
  l as (select grp, doc, sum(tf) dl from {name}_tf group by grp, doc),
  s as (select qt.grp, qt.q, p.doc,
               sum(qtf * idf * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)))) score
        from qt join {name}_terms t on qt.grp = t.grp and qt.term = t.term
        join {name}_tf p on p.grp = t.grp and p.term = t.term
        join l on l.grp = p.grp and l.doc = p.doc
        group by qt.grp, qt.q, p.doc)
  select * from (select *, row_number() over (partition by grp, q order by round(score, 9) desc, doc) "rank" from s)
  where "rank" <= {k} and score > 0""",
        queries,
        f"{name}_terms",
        f"{name}_tf",
    )


_STOP = "(" + ", ".join(_lit(w) for w in config.STOP_WORDS) + ")"


def _tfidf(name: str, corpus: str, features: int | None, min_df: int, ngrams: int, source: str | None = None) -> None:
    """``name_vocab`` and ``name`` (grp, doc, term, w) of the corpus, or of ``source`` under its vocabulary."""

    def terms(table: str) -> str:
        base = (
            f"select grp, doc, list_filter(regexp_extract_all(text, '{_WORDS}'), lambda w: w not in {_STOP}) ws from {table}"
        )
        grams = "unnest(ws) term"
        if ngrams == 2:
            grams = (
                "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) term"
            )
        return f"select grp, doc, term, count(*) tf from (select grp, doc, {grams} from ({base})) group by grp, doc, term"

    _part(f"{name}_tf", terms(corpus), corpus)
    _part(
        f"{name}_vocab",
        f"""
  select term, ln((1e0 + (select count(*) from {corpus})) / (1 + df)) + 1 idf from (
    select term, count(*) df, sum(tf) total from {name}_tf group by term
    having count(*) >= {min_df} order by total desc, term{f' limit {features}' if features else ''})""",
        f"{name}_tf",
        corpus,
    )
    weigh = f"""
  with r as (select t.grp, t.doc, t.term, t.tf * v.idf raw from {{}} t join {name}_vocab v on t.term = v.term)
  select grp, doc, term, raw / sqrt(sum(raw*raw) over (partition by grp, doc)) w from r"""
    _part(name, weigh.format(f"{name}_tf"), f"{name}_tf", f"{name}_vocab")
    if source:
        _part(f"{name}_q_tf", terms(source), source)
        _part(f"{name}_q", weigh.format(f"{name}_q_tf"), f"{name}_q_tf", f"{name}_vocab")


def _cosine(name: str, vectors: str, queries: str, k: int) -> None:
    _part(
        name,
        f"""
  with s as (select a.grp, a.doc q, b.doc, sum(a.w * b.w) score
             from {queries} a join {vectors} b on a.grp = b.grp and a.term = b.term group by a.grp, a.doc, b.doc)
  select * from (select *, row_number() over (partition by grp, q order by round(score, 9) desc, doc) "rank" from s)
  where "rank" <= {k}""",
        queries,
        vectors,
    )


def _fuse(name: str, dense: str, sparse: str, k: int = 6) -> None:
    _part(
        name,
        f"""
  with f as (select coalesce(d.q, b.q) q, coalesce(d.doc, b.doc) doc, coalesce(d.score, 0) similarity_score,
                    coalesce(b.score, 0) lexical_score,
                    coalesce(0.6e0 / (60 + d."rank"), 0) + coalesce(0.4e0 / (60 + b."rank"), 0) rrf_score
             from {dense} d full outer join {sparse} b on d.q = b.q and d.doc = b.doc)
  select * from (select *, row_number() over (partition by q order by round(rrf_score, 12) desc, doc) "rank" from f)
  where "rank" <= {k}""",
        dense,
        sparse,
    )


_bm25("bm", "items", "docs", 15)
_tfidf("tfv", "docs", None, 1, 1, "items")
_cosine("cos", "tfv", "tfv_q", 15)
_fuse("fused", "cos", "bm")
_bm25("bmp", "items", "passages", 15)
_bm25("bmt", "brand_tickets", "brand_passages", 15)
_tfidf("tft", "brand_passages", None, 1, 1, "brand_tickets")
_cosine("cost", "tft", "tft_q", 15)
_fuse("fusedt", "cost", "bmt")


def _jaccard(a: str, b: str) -> str:
    wa = f"list_distinct(regexp_extract_all(lower({a}), '{_WORDS}'))"
    wb = f"list_distinct(regexp_extract_all(lower({b}), '{_WORDS}'))"
    both = f"len(list_intersect({wa}, {wb}))"
    return f"coalesce({both} / nullif(cast(len({wa}) + len({wb}) - {both} as double), 0), 0)"


def _rerank(name: str, source: str, floor: float, k: int = 3) -> None:
    _part(
        name,
        f"""
  with a as (select *, max(case when s >= {floor}e0 then 1 else 0 end) over (partition by q) ok from {source}),
  b as (select * from a where s >= {floor}e0 or ok = 0)
  select * from (select * exclude ("rank"), row_number() over (partition by q order by round(s, 9) desc, "rank") "rank" from b)
  where "rank" <= {k}""",
        source,
    )


_part(
    "scored_docs",
    f"""select f.q, f.doc, f."rank", {_jaccard('i.text', 'd.text')} s
  from fused f join documents d on f.doc = d.doc_id join benchmark i on f.q = i.item_id""",
    "fused",
)
_rerank("reranked_docs", "scored_docs", 0.08)
_part(
    "scored_threads",
    f"""select f.*, {_jaccard('t.customer_query', 'p.agent_reply')} s
  from fusedt f join threads t on f.q = t.thread_id join threads p on f.doc = 'passage_' || p.thread_id""",
    "fusedt",
    "threads",
)
_rerank("contexts", "scored_threads", -10.0)

# ------------------------------------------------------------ sources and sinks

_oracle("scan_tweets_csv", "select tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id from tweets", "tweets")
_CORPUS = "select 'passage_' || thread_id passage_id, brand, customer_query, agent_reply historical_resolution from threads"
_oracle("scan_corpus_jsonl", _CORPUS, "threads")
_oracle("sink_threads", "select thread_id, brand, customer_query, agent_reply from threads", "threads")
_oracle("sink_corpus", "select brand, count(*) n_passages from threads group by brand", "threads")
_oracle(
    "sink_openings_csv",
    "select thread_id, customer_tweet_id, customer_query, customer_created_at created_at from threads",
    "threads",
)
_QHAT = "least(1e0, ceil((n + 1) * (1 - {a}e0)) / n)"


def _qhat(alpha: float) -> str:
    level = _QHAT.format(a=alpha)
    return (
        f"select {alpha}e0 alpha, n, {level} \"level\", "
        f"(s[cast(floor({level} * (n - 1)) as bigint) + 1] * (1 - ({level} * (n - 1) - floor({level} * (n - 1)))) "
        f"+ s[cast(ceil({level} * (n - 1)) as bigint) + 1] * ({level} * (n - 1) - floor({level} * (n - 1)))) q_hat "
        "from (select count(*) n, list(1 - p_true order by 1 - p_true) s from predictions)"
    )


_part("qhats", f"{_qhat(0.05)} union all {_qhat(0.1)}", "predictions")
_oracle("conformal_quantile", 'select alpha, n, round("level", 6) "level", round(q_hat, 6) q_hat from qhats', "qhats")
_oracle("conformal_quantile_sketch", 'select alpha, n, round("level", 6) "level", true within_error from qhats', "qhats")
_oracle("load_params", "select 1e0 temperature, alpha, round(q_hat, 6) q_hat from qhats where alpha = 0.05e0", "qhats")
_oracle(
    "sink_index",
    """select 'corpus' part, (select count(*) from threads) n_rows
  union all select 'vectors', (select count(*) from embeddings)
  union all select 'postings', (select count(*) from (
    select distinct brand, q, unnest(list_filter(string_split(q, ' '), lambda w: w <> '')) term
    from (select brand, lower(customer_query) q from threads)))""",
    "threads",
)
_oracle("dataset_profile", "select count(*) n_rows, 'doc_id,text,lang,source,n_chars' as columns from documents")
_oracle(
    "intent_dim",
    "select d.brand, d.intent_id, d.name, cast(d.k as bigint) n_keywords, d.eligible auto_handle_eligible, "
    "coalesce(c.n, 0) n_documents from (values "
    + ", ".join(
        f"({_lit(b.id)}, {_lit(x.id)}, {_lit(x.name)}, {len(x.keywords)}, {str(x.auto_handle_eligible).lower()})"
        for b in BRANDS.values()
        for x in b.intents
    )
    + ") d(brand, intent_id, name, k, eligible) left join (select "
    + _rules("text", config.INTENT_RULES, config.DEFAULT_INTENT)
    + " intent_id, count(*) n from documents group by 1) c on d.intent_id = c.intent_id",
)

# ------------------------------------------------------------------- scalars

_oracle("html_unescape", "select doc_id, replace(replace(text, ' the ', ' &lt;the> '), ' de ', ' ''dé\" ') text from documents")
_oracle("normalize_text", f"select doc_id, {_norm('text')} text from documents")
_oracle("strip_handles", f"select doc_id, {_norm(_handles('text'))} text from documents")
_oracle("redact_email", f"select doc_id, {_email('text')} text from documents")
_oracle("redact_credit_card", f"select doc_id, {_card('text')} text from documents")
_oracle("redact_order_id", f"select doc_id, {_order('text')} text from documents")
_oracle("redact_phone", f"select doc_id, {_phone('text')} text from documents")
_oracle("sanitize_pii", f"select doc_id, {_sanitize('text')} text from documents")
_oracle(
    "pii_counts",
    f"""select doc_id, len(regexp_extract_all(text, '{X.EMAIL}')) n_email,
  len(regexp_extract_all(text, '{X.CREDIT_CARD}')) n_credit_card,
  len(regexp_extract_all({_marked('text')}, '{_ORDER_MARKED}')) n_order_id,
  len(regexp_extract_all(text, '{X.PHONE}')) n_phone from documents""",
)
_oracle(
    "cjk_filter",
    """select doc_id, length(trim(t)) < 5 or not regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]') is_english
  from (select doc_id, case when lang = 'es' then 'カスタマー ' || text else text end t from documents)""",
)
_oracle(
    "language_filter",
    """select d.doc_id, x.detected,
  length(trim(text)) < 5 or (not regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]')
                             and coalesce(x.detected = 'en', true)) is_kept
  from documents d left join detected x on d.doc_id = x.doc_id""",
    "detected",
)
_oracle("sentiment_score", "select doc_id, round(sentiment, 6) sentiment from doc_sentiment", "doc_sentiment")
_oracle(
    "sentiment_flags",
    "select doc_id, sentiment < -0.40e0 policy_negative, sentiment < -0.45e0 golden_negative, "
    "sentiment < -0.50e0 baseline_negative from doc_sentiment",
    "doc_sentiment",
)
_oracle(
    "keyword_any",
    f"select doc_id, {_any('text', config.RISK_KEYWORDS)} has_default_keyword, {_any('text', RISK_WORDS)} has_keyword, "
    "len(list_intersect(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ["
    + ", ".join(map(_lit, RISK_WORDS))
    + "])) > 0 has_word from documents",
)
_oracle("keyword_first", f"select doc_id, {_first('text', RISK_WORDS)} keyword from documents")
_oracle("length_filter", f"select doc_id, length({_norm('text')}) n from documents where length({_norm('text')}) >= 100")
_oracle("brand_outbound_filter", "select tweet_id, 'BRAND1' brand from tweets where not inbound and lower(author_id) = 'brand1'", "tweets")
_oracle(
    "null_reject",
    "select tweet_id, in_response_to_tweet_id from tweets where in_response_to_tweet_id is not null and text <> ''",
    "tweets",
)
_oracle(
    "id_templates",
    """select thread_id, 'passage_' || thread_id passage_id, lower(brand) || '_gold_' || lpad(cast(
    row_number() over (partition by brand order by md5('42:' || thread_id), thread_id) as varchar), 4, '0') example_id
  from threads""",
    "threads",
)
_oracle(
    "intent_rule_cascade",
    f"select doc_id, {_rules('text', config.INTENT_RULES, config.DEFAULT_INTENT)} intent, 0.85e0 confidence from documents",
)
_oracle(
    "intent_validate",
    "select ticket_id, predicted_intent, coalesce(i.intent_id, f.intent_id) valid_intent "
    "from tickets t left join intents i on predicted_intent = i.intent_id and t.brand = i.brand "
    "left join intents f on f.ord = 0 and t.brand = f.brand",
    "tickets",
    "intents",
)
_oracle(
    "keyword_intent_score",
    """select doc_id, case when hits > 0 then intent0 end intent, cast(hits as bigint) hits from (
  select *, row_number() over (partition by doc_id order by hits desc, o) i from (
    """
    + " union all ".join(
        f"select doc_id, {i} o, {_lit(intent)} intent0, "
        + " + ".join(f"cast(contains(lower(text), {_lit(k)}) as int)" for k in keys)
        + " hits from documents"
        for i, (intent, keys) in enumerate(RULES)
    )
    + ")) where i = 1",
)
_oracle(
    "softmax_temperature",
    """select vec_id, k, round(exp((x - m) / 1.5e0) / sum(exp((x - m) / 1.5e0)) over (partition by vec_id), 6) p
  from (select vec_id, k, z / 0.02e0 x, max(z / 0.02e0) over (partition by vec_id) m from probs)""",
    "probs",
)


_oracle(
    "load_index",
    'select q, doc, "rank", round(score, 6) score from bmp',
    "bmp",
)


def _values(name: str, values) -> str:
    return "(values " + ", ".join(f"({i}, {v}e0)" for i, v in enumerate(values)) + f") {name}(k, t)"


THRESHOLDS = (0.5, 0.6, 0.5, 0.4, 0.5, 0.5, 0.7, 0.5, 0.5, 0.3)
_oracle(
    "threshold_argmax",
    f"""select vec_id, k pred, round(p, 6) confidence from (
  select p.*, row_number() over (partition by vec_id order by p / t desc, p.k) i
  from probs p join {_values('th', THRESHOLDS)} on p.k = th.k) where i = 1""",
    "probs",
)
_oracle(
    "secondary_intents",
    """select vec_id, coalesce(string_agg(cast(k as varchar), ',' order by r) filter (where r in (2, 3) and p > 0.15e0), '') secondary
  from ranked group by vec_id""",
    "ranked",
)
_oracle("label_topn", 'select vec_id, r "rank", k, round(p, 6) p from ranked where r <= 3', "ranked")


def _prompt(*pieces: str) -> str:
    return " || ".join(pieces)


_A = AMAZONHELP
_part(
    "item_contexts",
    """select b.q, string_agg('[' || b.doc || '] asked: "' || t.customer_query || '" answered: "' || t.agent_reply || '"',
    chr(10) || chr(10) order by b."rank") context_text
  from bmp b join threads t on b.doc = 'passage_' || t.thread_id where b."rank" <= 3 group by b.q""",
    "bmp",
    "threads",
)
_oracle(
    "prompt_table",
    "select item_id, "
    + _prompt(
        _lit(
            f"Classify messages for {_A.display_name}. Choose one intent id:\n{prompts.intent_lines(_A)}\n\nExamples:\n"
            + prompts.exemplar_lines()
            + '\n\nAnswer with an intent id, a confidence from 0 to 1 and, if unsure, other candidates.\nMessage: "'
        ),
        _norm("text"),
        "'\"'",
    )
    + " classifier_prompt, "
    + _prompt(
        _lit(
            f"Annotate messages for {_A.display_name}. Choose one intent id:\n{prompts.intent_lines(_A, 0)}\n"
            'State whether a person must handle it.\nMessage: "'
        ),
        "text",
        "'\"'",
    )
    + " annotator_prompt, "
    + _prompt(
        _lit(
            f"Write a support reply for {_A.display_name}. Tone: {_A.persona.tone}. Greeting: {_A.persona.greeting} "
            f"Sign-off: {_A.persona.signoff} Link: {_A.persona.dm_action_url}\n"
            "Use only the sources, promise nothing, name a next step, stay within 280 characters.\n"
            'Message: "'
        ),
        _norm("text"),
        _lit('"\nIntent: '),
        _classify("text"),
        _lit("\nSources:\n"),
        f"coalesce(c.context_text, {_lit(prompts.NO_CONTEXT)})",
    )
    + " draft_prompt, "
    + _prompt(
        _lit(
            "Rate a support reply of @AmazonHelp from 1 to 5 on grounding, tone, actionability, "
            'safety and overall quality.\nMessage: "'
        ),
        "text",
        _lit('"\nSources:\n'),
        f"coalesce(c.context_text, {_lit(prompts.NO_SOURCES)})",
        _lit('\nReply: "'),
        _lit(config.OFFLINE_DRAFT),
        "'\"'",
    )
    + " judge_prompt from benchmark left join item_contexts c on item_id = c.q",
    "item_contexts",
)
_oracle(
    "draft_from_top1",
    f"""select item_id ticket_id, coalesce(t.agent_reply, {_lit(config.BASELINE_REPLY)}) draft_reply,
  coalesce(round(b.score, 6), 0) lexical_score
  from benchmark left join (select * from bmp where "rank" = 1) b on item_id = b.q
  left join threads t on b.doc = 'passage_' || t.thread_id""",
    "bmp",
    "threads",
)
_oracle(
    "draft_checks",
    """select thread_id, length(agent_reply) <= 280 fits_length, contains(agent_reply, '[EMAIL]') has_action_link,
  regexp_matches(agent_reply, '(?i)\\b(i|we)(''ve| have)? (refunded|credited|reimbursed|guarantee)|\\bwill arrive (on|by)\\b') has_promise
  from threads""",
    "threads",
)

# --------------------------------------------------------------------- joins

_oracle("reply_parent_join", "select * from joined", "joined")
_oracle("thread_reconstruct", "select * from threads", "threads")
_part(
    "looped",
    """
  select tweet_id, case when cast(tweet_id as bigint) % 1000 = 0 and cast(tweet_id as bigint) // 1000 % 50 = 1
                        then cast(cast(tweet_id as bigint) + 1 as varchar) else in_response_to_tweet_id end ptr from tweets""",
    "tweets",
)
_part(
    "hops",
    """
  select t.tweet_id, t.tweet_id root_id, cast(0 as bigint) depth from looped t
  where t.ptr is null or t.ptr not in (select tweet_id from looped)
  union all
  select t.tweet_id, h.root_id, h.depth + 1 from looped t join hops h on t.ptr = h.tweet_id""",
    "looped",
)
_oracle(
    "thread_multi_hop",
    """select tweet_id, root_id, depth, false "cycle" from hops
  union all select tweet_id, null, null, true from looped where tweet_id not in (select tweet_id from hops)""",
    "hops",
)
ORACLES["thread_multi_hop"] = ORACLES["thread_multi_hop"].replace("hops as materialized (", "hops as (")
_oracle(
    "thread_turns",
    """select root_id, (pos - 1) // 4 piece_no, min(pos) first_position, count(*) n_turns,
  string_agg(tweet_id || ':' || author_id || ':' || length("text"), ' ' order by pos) turns
from (select h.*, t.author_id, t."text",
        row_number() over (partition by root_id order by depth, cast(h.tweet_id as bigint), h.tweet_id) pos
      from hops h join tweets t on t.tweet_id = h.tweet_id) group by root_id, (pos - 1) // 4""",
    "hops",
)
ORACLES["thread_turns"] = ORACLES["thread_turns"].replace("hops as materialized (", "hops as (")
_part(
    "eligibility",
    "select t.*, i.name intent_name, coalesce(i.eligible, true) eligible, coalesce(i.ord, 0) ord "
    "from tickets t left join intents i on t.predicted_intent = i.intent_id and t.brand = i.brand",
    "tickets",
    "intents",
)
_oracle("intent_eligibility_join", "select ticket_id, predicted_intent, eligible from eligibility", "eligibility")
_oracle("label_index_join", "select ticket_id, cast(ord as bigint) label_id from eligibility", "eligibility")
_oracle(
    "gold_prelabel_join",
    """select vec_id example_id, y ground_truth_intent, y in (4, 9) ground_truth_escalate, 'gold' source_gold,
  pred llm_predicted_intent, pred in (4, 9) rule_escalate, 'rules' source_pre from predictions""",
    "predictions",
)
_TOP = 'select q, doc, "rank", round(score, 6) score from '
_oracle("bm25_score", _TOP + "bm", "bm")
_oracle("topk_lexical", _TOP + "bmp", "bmp")
_oracle("topk_similar", _TOP + "cos", "cos")
_oracle("dense_topk", 'select q, id, "rank", round(score, 6) score from near', "near")
_part(
    "near_vectors",
    """select min(id) id, vec from (
    select vec_id id, cast(embedding as double[]) vec from embeddings
    union all select vec_id + 10000000000, cast(embedding as double[]) from embeddings where vec_id % 25 = 0) group by vec""",
)
_oracle(
    "near_dup_pairs",
    """select x.id a, y.id b, round(list_dot_product(x.vec, y.vec), 6) similarity
from near_vectors x join near_vectors y on x.id < y.id where list_dot_product(x.vec, y.vec) >= 0.38""",
    "near_vectors",
)
_oracle(
    "near_dup_members",
    """select vec_id id, r.id representative from embeddings join near_vectors r on cast(embedding as double[]) = vec
union all select vec_id + 10000000000, r.id from embeddings join near_vectors r on cast(embedding as double[]) = vec where vec_id % 25 = 0""",
    "near_vectors",
)
_oracle(
    "rrf_fuse",
    """select q, doc, "rank", round(similarity_score, 6) similarity_score, round(lexical_score, 6) lexical_score,
  round(rrf_score, 9) rrf_score from fused""",
    "fused",
)
_oracle(
    "candidate_metadata_join",
    "select q, doc, 'general' intent, d.text historical_resolution from fused join documents d on doc = d.doc_id",
    "fused",
)
_part(
    "hits",
    """select q, id, score from (select *, row_number() over (partition by q order by round(score, 9) desc, id) i
  from sims where id < q) where i = 1 and score >= 0.38e0""",
    "sims",
)
_oracle(
    "semantic_cache_lookup",
    """select q, id cache_id, round(score, 6) similarity, 'intent_' || label predicted_intent, 1e0 classification_confidence,
  'semantic_cache_hit' classification_method, 'reply ' || id draft_reply, false should_escalate,
  'Resolved via semantic FAQ cache.' escalation_reason, 'LOW' risk_level, true cached
  from hits join embeddings on id = vec_id""",
    "hits",
)
_oracle("cache_miss", "select vec_id q from embeddings where vec_id not in (select q from hits)", "hits")
_oracle(
    "knn_exemplars",
    """with e as (select q, "rank", id exemplar_id, cast(label as bigint) intent, round(score, 6) score
             from near join embeddings on id = vec_id where "rank" <= 3),
  v as (select q, intent voted_intent, row_number() over (partition by q order by count(*) desc, min("rank")) i
        from e group by q, intent)
  select e.*, v.voted_intent from e join v on e.q = v.q where v.i = 1""".replace(
        "with e", "WITH_E", 1
    ),
    "near",
)
ORACLES["knn_exemplars"] = ORACLES["knn_exemplars"].replace("\nWITH_E", ",\ne", 1)

# -------------------------------------------------------------- aggregations

_oracle(
    "ingest_stats",
    """select brand, count(*) total_threads_reconstructed, count(*) total_rag_passages,
  round(avg(length(customer_query)), 6) avg_customer_query_length_chars, true language_filter_applied
  from threads group by brand""",
    "threads",
)
_oracle(
    "ingest_rollup",
    """select case when grouping(brand) = 1 then 'total' when grouping("day") = 1 then 'brand' else 'day' end "level", brand,
  cast("day" as varchar) "day", count(*) n_threads, round(avg(length(customer_query)), 6) avg_query_chars
  from (select *, cast(customer_created_at as date) "day" from threads) group by rollup (brand, "day")""",
    "threads",
)
_oracle(
    "bm25_corpus_stats",
    "select term, df, cast(total_tf as bigint) total_tf, round(idf, 6) idf, n_docs, round(avgdl, 6) avgdl from bm_terms",
    "bm_terms",
)
_tfidf("tf2", "docs", 5000, 3, 2)
_oracle("tfidf_vectors", "select doc, term, round(w, 6) w from tf2", "tf2")
_oracle("embed_text", "select doc item_id, term, round(w, 6) w from tfv_q", "tfv_q")
_part(
    "clustered",
    "select *, case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 else -1 end cluster from documents",
)
_oracle(
    "cluster_summary",
    """select cluster, count(*) size, round(count(*) / (select cast(count(*) as double) from clustered) * 100, 2) percentage,
  string_agg(cast(doc_id as varchar), ',' order by doc_id) filter (where i <= 3) exemplars
  from (select *, row_number() over (partition by cluster order by doc_id) i from clustered) group by cluster""",
    "clustered",
)
_part("kept", "select '' grp, doc_id doc, lower(text) text from clustered where cluster <> -1", "clustered")
_tfidf("tfk", "kept", 5000, 3, 2)
_oracle(
    "cluster_keywords",
    """select cluster, term, round(m, 6) mean_tfidf, i "rank" from (
  select *, row_number() over (partition by cluster order by round(m, 9) desc, term) i from (
    select c.cluster, v.term, sum(v.w) / max(n.n) m from tfk v join clustered c on v.doc = c.doc_id
    join (select cluster, count(*) n from clustered group by cluster) n on n.cluster = c.cluster
    group by c.cluster, v.term)) where i <= 8""",
    "tfk",
    "clustered",
)
_oracle("confusion_matrix", "select y true_label, pred pred_label, count(*) n from predictions group by y, pred", "predictions")


def _f1s(source: str, key: str, true: str, pred: str, labels: int) -> str:
    """Per key and label: tp, predicted, actual."""
    return f"""
  select {key} key, l.k, count(*) filter (where {true} = l.k and {pred} = l.k) tp,
         count(*) filter (where {pred} = l.k) predicted, count(*) filter (where {true} = l.k) actual,
         count(*) n, count(*) filter (where {true} = {pred}) same
  from {source}, (select unnest(range({labels})) k) l group by {key}, l.k"""


_F1 = "coalesce(2e0 * tp / nullif(predicted + actual, 0), 0)"
_part("class_scores", _f1s("predictions", "cast(0 as int)", "y", "pred", 10), "predictions")
_oracle(
    "classification_metrics",
    f"""select round(max(same) / max(cast(n as double)), 6) accuracy, round(sum({_F1}) / 11, 6) macro_f1,
  round(sum({_F1} * actual) / sum(actual), 6) weighted_f1,
  round(sum(coalesce(tp / nullif(cast(predicted as double), 0), 0)) / 11, 6) macro_precision,
  round(sum(coalesce(tp / nullif(cast(actual as double), 0), 0)) / 11, 6) macro_recall from class_scores""",
    "class_scores",
)


def _esc_counts(source: str, key: str, true: str, pred: str) -> str:
    return f"""
  select {key} key, cast(count(*) as double) n, count(*) filter (where {true} and not {pred}) fa,
         count(*) filter (where not {true} and {pred}) fe, count(*) filter (where not {true} and not {pred}) ta,
         count(*) filter (where {true} and {pred}) te from {source} group by {key}"""


_REASON = f"""case tier
    when 'intent_policy' then 'Security Policy: Intent ''' || intent_name || ''' is classified as human-only handling.'
    when 'risk_keyword' then 'Risk Trigger: Critical keyword ''' || kw || ''' detected in customer message.'
    when 'sentiment' then 'Sentiment Trigger: High customer frustration detected (Sentiment Score: ' || printf('%.2f', sentiment) || ').'
    when 'turns' then 'Frustration Trigger: Customer has engaged in ' || turn_count || ' turns without resolution.'
    when 'confidence' then 'Model Uncertainty: Classifier confidence (' || printf('%.2f', confidence) || ') below threshold (0.70).'
    when 'grounding' then 'Grounding Uncertainty: No sufficiently similar historical resolutions found in database.'
    else 'Standard customer inquiry with high classification confidence and grounding.' end"""
_RISK = """case tier when 'risk_keyword' then 'CRITICAL' when 'intent_policy' then 'HIGH' when 'sentiment' then 'HIGH'
    when 'turns' then 'MEDIUM' when 'confidence' then 'MEDIUM' else 'LOW' end"""


def _policy(name: str, source: str, *needs: str) -> None:
    """Needs query, eligible, intent_name, sentiment, turn_count, confidence, rag_similarity."""
    _part(
        name,
        f"""
  with k as (select *, {_first(_norm('query'), RISK_WORDS)} kw from {source}),
  t as (select *, case when not eligible then 'intent_policy' when kw is not null then 'risk_keyword'
                       when sentiment < -0.40e0 then 'sentiment' when turn_count >= 3 then 'turns'
                       when confidence < 0.70e0 then 'confidence' when rag_similarity < 0.65e0 then 'grounding'
                       else 'auto' end tier from k)
  select *, tier <> 'auto' should_escalate, {_RISK} risk_level, {_REASON} escalation_reason from t""",
        *needs,
    )


_part(
    "policy_input",
    "select e.*, s.sentiment from eligibility e join ticket_sentiment s on e.ticket_id = s.ticket_id",
    "eligibility",
    "ticket_sentiment",
)
_policy("decided", "policy_input", "policy_input")
_part("esc_counts", _esc_counts("decided", "cast(0 as int)", "true_escalate", "should_escalate"), "decided")
_oracle(
    "escalation_metrics",
    """select round((ta + te) / n, 6) accuracy, round(coalesce(te / nullif(cast(te + fe as double), 0), 0), 6) "precision",
  round(coalesce(te / nullif(cast(te + fa as double), 0), 0), 6) recall,
  round(coalesce(2e0 * te / nullif(2 * te + fa + fe, 0), 0), 6) f1, fa false_auto_handle_count, fe false_escalation_count,
  ta true_auto_handle_count, te true_escalation_count, fa * 10e0 + fe * 1.5e0 total_business_cost,
  round((fa * 10e0 + fe * 1.5e0) / n, 6) average_cost_per_ticket from esc_counts""",
    "esc_counts",
)
_part(
    "bins",
    """select i bin, count(*) n, avg(cast(correct as int)) accuracy, avg(confidence) confidence
  from predictions, (select unnest(range(1, 11)) i)
  where confidence > (i - 1) * 0.1e0 and confidence <= i * 0.1e0 group by i""",
    "predictions",
)
_oracle("reliability_table", "select bin, n, round(accuracy, 6) accuracy, round(confidence, 6) confidence from bins", "bins")
_oracle(
    "calibration_error",
    "select round(sum(abs(accuracy - confidence) * n) / (select count(*) from predictions), 6) ece from bins",
    "bins",
    "predictions",
)


def _kappa(a: str, b: str) -> str:
    n = "(select cast(count(*) as double) from predictions)"
    po = f"(select count(*) from predictions where {a} = {b}) / {n}"
    pe = (
        f"(select sum(x.c * y.c) from (select {a} v, cast(count(*) as double) c from predictions group by 1) x "
        f"join (select {b} v, count(*) c from predictions group by 1) y on x.v = y.v) / ({n} * {n})"
    )
    return f"round(({po} - {pe}) / nullif(1 - {pe}, 0), 6)"


_oracle(
    "annotation_agreement",
    f"""select (select count(*) from predictions) total_samples, {_kappa('y', 'pred')} intent_cohens_kappa,
  round((select avg(cast(y = pred as int)) from predictions), 6) intent_percent_agreement,
  (select count(*) from predictions where y <> pred) human_corrections_count,
  {_kappa('(y in (4, 9))', '(pred in (4, 9))')} escalation_cohens_kappa,
  round((select avg(cast((y in (4, 9)) = (pred in (4, 9)) as int)) from predictions), 6) escalation_percent_agreement""",
    "predictions",
)
_part(
    "gated",
    """select p.vec_id, any_value(p.y) y, coalesce(string_agg(cast(k as varchar), ',' order by k) filter (where 1 - p <= q_hat), '') prediction_set,
  count(*) filter (where 1 - p <= q_hat) set_size, count(*) filter (where 1 - p <= q_hat and k = y) = 1 hit
  from probs p, (select q_hat from qhats where alpha = 0.1e0) group by p.vec_id""",
    "probs",
    "qhats",
)
_oracle("conformal_gate", "select vec_id, prediction_set, set_size, set_size = 1 auto_handle from gated", "gated")
_oracle(
    "conformal_coverage",
    """select count(*) n, round(avg(cast(hit as int)), 6) coverage, round(avg(cast(set_size = 1 as int)), 6) singleton_share,
  round(avg(cast(not hit as int)) filter (where set_size = 1), 6) singleton_error,
  round(avg(cast(set_size = 0 as int)), 6) empty_share from gated""",
    "gated",
)
_part(
    "curve",
    """select i * 0.01e0 t, count(*) filter (where not correct and confidence >= i * 0.01e0) fa,
  count(*) filter (where correct and not confidence >= i * 0.01e0) fe, count(*) n
  from predictions, (select unnest(range(101)) i) group by i""",
    "predictions",
)
_CURVE = (
    "fa false_auto_handles, fe false_escalations, fa * 10e0 + fe * 1.5e0 total_cost, "
    "round((fa * 10e0 + fe * 1.5e0) / n, 6) avg_cost_per_ticket from curve"
)
_oracle("cost_curve", f"select round(t, 6) t, {_CURVE}", "curve")
_oracle("cost_threshold_sweep", f"select round(t, 6) optimal_threshold, {_CURVE} order by fa * 10e0 + fe * 1.5e0, t limit 1", "curve")


def _nll(grid: str) -> str:
    return f"""
  select t, avg(-ln(greatest(least(pt, 1e0), 1e-12))) nll from (
    select t, vec_id, sum(case when k = y then exp((x - m) / t) end) / sum(exp((x - m) / t)) pt
    from (select vec_id, k, y, z / 0.02e0 x, max(z / 0.02e0) over (partition by vec_id) m from probs), ({grid}) g
    group by t, vec_id) group by t"""


_part("coarse", _nll("select i * 0.05e0 t from (select unnest(range(1, 101)) i)"), "probs")
_part("centre", "select t c from coarse order by round(nll, 12), t limit 1", "coarse")
_part(
    "fine",
    _nll(
        "select distinct round(greatest(0.05e0, least(5e0, c + i * 0.001e0)), 3) t from centre, (select unnest(range(-50, 51)) i)"
    ),
    "probs",
    "centre",
)
_oracle("temperature_curve", "select round(t, 6) t, round(nll, 6) nll from coarse", "coarse")
_oracle("temperature_fit", "select round(t, 6) temperature, round(nll, 6) nll from fine order by round(nll, 12), t limit 1", "fine")
_oracle(
    "sink_params",
    """select (select round(t, 6) from fine order by round(nll, 12), t limit 1) temperature, alpha, round(q_hat, 6) q_hat
  from qhats where alpha = 0.1e0""",
    "fine",
    "qhats",
)
_part(
    "swept",
    f"""select c candidate, vec_id, y, k pred from (
  select p.*, c, row_number() over (partition by c, vec_id order by p / case when p.k = 0 then c else t end desc, p.k) i
  from probs p join {_values('th', THRESHOLDS)} on p.k = th.k, (select unnest(range(1, 10)) / 10e0 c)) where i = 1""",
    "probs",
)
_part("swept_scores", _f1s("swept", "candidate", "y", "pred", 10), "swept")
_oracle(
    "class_threshold_sweep",
    f"""select key candidate, round(avg({_F1}) filter (where predicted + actual > 0), 6) macro_f1 from swept_scores group by key""",
    "swept_scores",
)
_oracle(
    "focal_loss",
    "select y, round(avg(pow(1 - p_true, 2) * -ln(greatest(p_true, 1e-12))), 6) focal_loss, count(*) n from predictions group by y",
    "predictions",
)
_part(
    "runs",
    """
  with major as (select y m from predictions group by y order by count(*) desc, y limit 1),
  nn as (select q, cast(label as bigint) pred from near join embeddings on id = vec_id where "rank" = 1),
  u as (select 'V0' variant, vec_id, y, m pred, 0.1e0 latency from predictions, major
        union all select 'V1', vec_id, y, pred, 1.8e0 from predictions
        union all select 'V2', vec_id, y, nn.pred, 3e0 from predictions join nn on vec_id = q)
  select *, y in (4, 9) te, pred in (4, 9) pe, 3 + vec_id % 5 * 0.25e0 judge,
         row_number() over (partition by variant order by vec_id) i from u""",
    "predictions",
    "near",
)
_oracle("variant_union", "select variant, vec_id example_id, y true_intent, pred pred_intent from runs", "runs")
_part("run_scores", _f1s("runs", "variant", "y", "pred", 10), "runs")
_part("run_counts", _esc_counts("runs", "variant", "te", "pe"), "runs")
_oracle(
    "variant_rollup",
    """select ['both', 'variant', 'intent', 'total'][1 + 2 * grouping(variant) + grouping(y)] "level", variant, y true_intent, count(*) n,
  round(avg(cast(y = pred as double)), 6) intent_accuracy, round(avg(cast((y in (4, 9)) = (pred in (4, 9)) as double)), 6) escalation_accuracy
  from runs group by cube (variant, y)""",
    "runs",
)
_oracle(
    "variant_comparison",
    f"""select c.key variant, round(s.acc, 3) intent_accuracy, round(s.f1, 3) intent_macro_f1,
  round((ta + te) / n, 3) escalation_accuracy, round(coalesce(te / nullif(cast(te + fe as double), 0), 0), 3) escalation_precision,
  round(coalesce(te / nullif(cast(te + fa as double), 0), 0), 3) escalation_recall, fa false_auto_handles, fe false_escalations,
  round(fa * 10e0 + fe * 1.5e0, 2) total_cost, round((fa * 10e0 + fe * 1.5e0) / n, 2) avg_cost_per_ticket,
  round(l.latency, 1) avg_latency_ms, round(l.judge, 2) judge_faithfulness
  from run_counts c
  join (select key, max(same) / max(cast(n as double)) acc, avg({_F1}) f1 from run_scores group by key) s on s.key = c.key
  join (select variant, avg(latency) latency, avg(judge) judge from runs group by variant) l
    on l.variant = c.key""",
    "run_counts",
    "run_scores",
    "runs",
)
_oracle(
    "class_distribution",
    "select y, count(*) n, round(count(*) / (select cast(count(*) as double) from predictions), 6) share from predictions group by y",
    "predictions",
)
_oracle("majority_class", "select y, count(*) n from predictions group by y order by n desc, y limit 1", "predictions")
_oracle(
    "judge_summary",
    """select quality, count(*) filter (where ok) n_valid, count(*) filter (where not ok) n_rejected,
  round(avg(a) filter (where ok), 6) avg_grounding_faithfulness, round(avg(b) filter (where ok), 6) avg_brand_tone_adherence,
  round(avg(c) filter (where ok), 6) avg_actionability, round(avg(d) filter (where ok), 6) avg_safety_anti_commitment,
  round(avg(e) filter (where ok), 6) avg_overall_quality
  from (select *, a between 1 and 5 and b between 1 and 5 and c between 1 and 5 and d between 1 and 5 and e between 1 and 5 ok
        from (select cast(quality as bigint) quality, 0.5e0 + doc_id % 10 * 0.5e0 a, 1e0 + doc_id % 9 * 0.5e0 b,
                     1e0 + doc_id % 5 c, 5e0 - doc_id % 4 d, 2e0 + doc_id % 7 * 0.5e0 e from labels))
  group by quality""",
)

# -------------------------------------------------------- windows and ranking

_oracle(
    "first_reply_per_customer",
    """select brand, parent_id, reply_id from (
  select *, row_number() over (partition by brand, parent_id order by cast(reply_id as bigint)) i from joined) where i = 1""",
    "joined",
)
_oracle("rerank_topk", 'select q, doc, "rank", round(s, 6) rerank_score from reranked_docs', "reranked_docs")
_part(
    "mmr1",
    'select q, id, score rel, "rank" from near',
    "near",
)
_part("pick1", 'select q, id from mmr1 where "rank" = 1', "mmr1")
_part(
    "gain2",
    """select m.*, s.score near1, row_number() over (partition by m.q order by round(0.7e0 * rel - (1 - 0.7e0) * s.score, 12) desc, "rank") i
  from mmr1 m join pick1 p on m.q = p.q join sims s on s.q = p.id and s.id = m.id""",
    "mmr1",
    "pick1",
    "sims",
)
_part("pick2", "select q, id from gain2 where i = 1", "gain2")
_part(
    "gain3",
    """select g.q, g.id, row_number() over (partition by g.q
    order by round(0.7e0 * rel - (1 - 0.7e0) * greatest(near1, s.score), 12) desc, g."rank") i
  from gain2 g join pick2 p on g.q = p.q join sims s on s.q = p.id and s.id = g.id where g.i > 1""",
    "gain2",
    "pick2",
    "sims",
)
_oracle(
    "mmr_select",
    """select q, id, cast(1 as bigint) pick from pick1 union all select q, id, 2 from pick2
  union all select q, id, 3 from gain3 where i = 1""",
    "pick1",
    "pick2",
    "gain3",
)
_oracle(
    "turn_counter",
    """select tweet_id, author_id, n turn_no, n >= 3 turn_trigger from (
  select *, row_number() over (partition by author_id order by created_at, cast(tweet_id as bigint)) n from tweets where inbound)""",
    "tweets",
)
_oracle(
    "fragment_merge",
    """with a as (select *, case when (turn // 2) % 2 = 0 then 'a' else 'b' end author from conversations),
  l as (select *, case when author = lag(author) over (partition by conv_id order by turn) then 0 else 1 end st from a),
  f as (select *, sum(st) over (partition by conv_id order by turn) fragment_no from l)
  select conv_id, cast(fragment_no as bigint) fragment_no, any_value(author) author,
         min(turn) first_order, count(*) n_messages, string_agg(text, chr(10) order by turn) text
  from f group by conv_id, fragment_no""",
)

# ------------------------------------------------------- samples, splits, sets

_oracle(
    "limit_threads",
    """select thread_id, brand from (
  select *, row_number() over (partition by brand order by cast(agent_tweet_id as bigint)) i from threads) where i <= 20""",
    "threads",
)
_oracle("seeded_sample", "select doc_id, lang from documents order by md5('42:' || doc_id), doc_id limit 200")
_oracle("head_n", "select ticket_id, brand from tickets order by ticket_id limit 50", "tickets")
_oracle(
    "stratified_split",
    """select vec_id, 'class_' || label name, case when i <= ceil(n * 0.25e0) then 'test' else 'train' end split from (
  select vec_id, label, row_number() over (partition by label order by md5('42:' || vec_id), vec_id) i,
         count(*) over (partition by label) n from embeddings)""",
)
_oracle("candidate_union", "select q, doc from cos union select q, doc from bm", "cos", "bm")
_oracle("seen_distinct", "select distinct customer_id from joined", "joined")
_oracle("corrections_except", "select vec_id example_id, y intent from predictions where y <> pred", "predictions")

# -------------------------------------------------------------- composed jobs

_oracle(
    "escalation_policy",
    "select ticket_id, tier, should_escalate, risk_level, escalation_reason, round(sentiment, 6) sentiment from decided",
    "decided",
)
_oracle(
    "escalation_tier_rollup",
    """select case when grouping(brand) = 1 then 'total' when grouping(tier) = 1 then 'brand' else 'tier' end "level",
  brand, tier, count(*) n, count(*) filter (where should_escalate) n_escalated from decided group by rollup (brand, tier)""",
    "decided",
)
_oracle("text_kmeans", "select count(*) n_texts, count(*) n_nearest, 10 n_starts, true chosen_is_least from threads", "threads")
_oracle("escalation_tier_counts", "select tier, risk_level, count(*) n from decided group by tier, risk_level", "decided")
_part(
    "golden",
    f"""
  with s as (select *, row_number() over (partition by brand order by md5('42:' || thread_id), thread_id) n from threads),
  c as (select s.*, {_classify('customer_query')} raw_intent, sentiment from s join thread_sentiment t on s.thread_id = t.thread_id
        where n <= 200),
  v as (select c.*, coalesce(i.intent_id, f.intent_id) intent, coalesce(i.eligible, true) eligible
        from c left join intents i on c.raw_intent = i.intent_id and c.brand = i.brand
        left join intents f on f.ord = 0 and c.brand = f.brand),
  k as (select * replace (coalesce(j.eligible, true) as eligible), {_any('customer_query', RISK_WORDS)} risky
        from v left join (select brand, intent_id, eligible from intents) j on v.intent = j.intent_id and v.brand = j.brand)
  select *, not eligible or risky or sentiment < -0.45e0 esc,
    case when not eligible then 'Intent ''' || intent || ''' requires human agent intervention per security policy.'
         when risky then 'Customer query contains high-risk legal/security escalation triggers.'
         when sentiment < -0.45e0 then 'Severe customer dissatisfaction detected (Sentiment: ' || printf('%.2f', sentiment) || ').'
         else 'Standard customer issue eligible for automated resolution.' end why,
    lower(brand) || '_gold_' || lpad(cast(n as varchar), 4, '0') example_id from k""".replace(
        "select * replace (coalesce(j.eligible, true) as eligible), ", "select v.* exclude (eligible), coalesce(j.eligible, true) eligible, "
    ),
    "threads",
    "thread_sentiment",
    "intents",
)
_oracle(
    "golden_label",
    """select example_id, brand, customer_query, intent ground_truth_intent, esc ground_truth_escalate,
  why escalation_rationale, true verified_by_human, round(sentiment, 6) sentiment_score,
  'Verified via LLM pre-label + deterministic rule audit' notes from golden""",
    "golden",
)
_oracle(
    "golden_prelabels",
    """select example_id, brand, customer_query, raw_intent llm_predicted_intent, 0.85e0 llm_confidence,
  'Keyword matched customer intent.' llm_reasoning, esc rule_escalate, round(sentiment, 6) sentiment_score from golden""",
    "golden",
)
_oracle("reuse_or_build", "select example_id, intent ground_truth_intent, esc ground_truth_escalate from golden", "golden")
_oracle(
    "cache_admission",
    "select ticket_id, predicted_intent from decided where not should_escalate and confidence >= 0.80e0",
    "decided",
)
_oracle(
    "top_similarity_default",
    """select thread_id ticket_id, round(coalesce(c.similarity_score, 0.5e0), 6) rag_similarity
  from threads left join (select * from contexts where "rank" = 1) c on thread_id = c.q""",
    "threads",
    "contexts",
)
_part("faq", f"select * from threads where {_classify(_norm('customer_query'))} = 'topic_thing'", "threads")
_collection("faq_texts", "faq", "thread_id", "customer_query", "brand", "faq")
_tfidf("tff", "faq_texts", None, 1, 1, "brand_tickets")
_cosine("cosf", "tff", "tff_q", 1)
_part("faq_hits", "select q, doc from cosf where score >= 0.97e0", "cosf")
_TICKETS = f"""
  with c as (select t.*, {_classify(_norm('customer_query'))} raw from threads t where WANTED),
  v as (select c.*, coalesce(i.intent_id, f.intent_id) intent from c
        left join intents i on c.raw = i.intent_id and c.brand = i.brand left join intents f on f.ord = 0 and c.brand = f.brand),
  r as (select q, max(similarity_score) filter (where "rank" = 1) sim, string_agg(doc, ',' order by "rank") contexts
        from contexts group by q)
  select v.thread_id, v.brand, v.customer_query query, v.intent, i.name intent_name, i.eligible, s.sentiment, 1 turn_count,
         0.85e0 confidence, coalesce(r.sim, 0.5e0) rag_similarity, coalesce(r.contexts, '') contexts
  from v join intents i on v.intent = i.intent_id and v.brand = i.brand join thread_sentiment s on s.thread_id = v.thread_id
  left join r on r.q = v.thread_id"""
_part(
    "open_tickets",
    _TICKETS.replace("WANTED", "thread_id not in (select q from faq_hits)"),
    "threads", "faq_hits", "intents", "contexts", "thread_sentiment",
)
_part("all_tickets", _TICKETS.replace("WANTED", "true"), "threads", "intents", "contexts", "thread_sentiment")
_policy("answered_all", "all_tickets", "all_tickets")
_ANSWERED = f"""select thread_id ticket_id, brand, intent predicted_intent, confidence classification_confidence,
    'track_a_few_shot_llm' classification_method, {_lit(config.OFFLINE_DRAFT)} draft_reply, should_escalate,
    escalation_reason, risk_level, false cached, contexts from """
_policy("answered", "open_tickets", "open_tickets")
_oracle(
    "score_tickets",
    _ANSWERED
    + """answered
  union all
  select t.thread_id, t.brand, 'topic_thing', 1e0, 'semantic_cache_hit', f.agent_reply, false,
    'Resolved via semantic FAQ cache.', 'LOW', true, '' from faq_hits h join threads t on h.q = t.thread_id
    join threads f on h.doc = f.thread_id""",
    "answered",
    "faq_hits",
    "threads",
)
_oracle(
    "baseline_trivial",
    f"""select ticket_id, (select predicted_intent from tickets group by 1 order by count(*) desc, 1 limit 1) predicted_intent,
  1e0 classification_confidence, 'trivial_majority_class' classification_method, {_lit(config.TRIVIAL_REPLY)} draft_reply,
  false should_escalate, 'Trivial baseline policy: never escalate.' escalation_reason, 'LOW' risk_level from tickets""",
    "tickets",
)
_oracle(
    "baseline_escalation",
    f"""select ticket_id, risky or angry should_escalate,
  case when risky then 'Simple ML baseline trigger: Critical keyword detected.'
       when angry then 'Simple ML baseline trigger: Negative sentiment (' || printf('%.2f', sentiment) || ').'
       else 'Simple ML baseline: Standard query, auto-handled.' end escalation_reason,
  case when risky or angry then 'HIGH' else 'LOW' end risk_level
  from (select t.ticket_id, sentiment, {_any(_norm('query'), RISK_WORDS)} risky, sentiment < -0.50e0 angry
        from tickets t join ticket_sentiment s on t.ticket_id = s.ticket_id)""",
    "tickets",
    "ticket_sentiment",
)
_oracle(
    "contrastive_pairs",
    f"""select 'passage_' || thread_id passage_id, customer_query anchor, agent_reply positive from (
  select thread_id, {_norm('customer_query')} customer_query, {_norm('agent_reply')} agent_reply from threads)
  where length(customer_query) > 10 and length(agent_reply) > 10""",
    "threads",
)
_oracle(
    "setfit_pairs",
    """with p as (select vec_id, label, row_number() over (partition by label order by md5('42:' || vec_id), vec_id) - 1 i,
                    count(*) over (partition by label) n from embeddings),
  b as (select label, n, sum(n) over (order by label) - n st from (select distinct label, n from p)),
  x as (select p.vec_id, p.i, p.n, b.st, (select count(*) from embeddings) - p.n o, b.st + p.i slot from p join b on p.label = b.label),
  s as (select vec_id, st + (i + j) % n slot, true same from x, (select unnest(range(1, 21)) j) where j <= n - 1
        union all
        select vec_id, case when k < st then k else k + n end, false from (
          select *, (i * 20 + j - 1) % o k from x, (select unnest(range(1, 21)) j) where j <= o))
  select s.vec_id a, x.vec_id b, same from s join x on s.slot = x.slot""",
)

# ------------------------------------------------------------------ streaming

_oracle("stream_score", _ANSWERED + "answered_all", "answered_all")
_CACHE_HITS = """select q, id from (
    select x.q, c.q id, row_number() over (partition by x.q order by round(list_dot_product(x.v, c.v), 9) desc, c.q) i
    from arrived x join {cache} c on x.batch = {batch} and list_dot_product(x.v, c.v) >= 0.38e0) where i = 1"""
_part(
    "arrived",
    """select vec_id q, cast(embedding as double[]) v, vec_id % 3 batch,
    label <> 4 and (vec_id * 37 % 51) / 100e0 + 0.5e0 >= 0.80e0 ok from embeddings""",
)
_part("cache0", "select q, v from arrived where batch = 0 and ok", "arrived")
_part("hits1", _CACHE_HITS.format(cache="cache0", batch=1), "cache0")
_part("cache1", "select * from cache0 union all select q, v from arrived where batch = 1 and ok and q not in (select q from hits1)", "hits1")
_part("hits2", _CACHE_HITS.format(cache="cache1", batch=2), "cache1")
_oracle(
    "stream_cache",
    """select a.q, batch, h.id cache_id, ok and h.id is null admitted
from arrived a left join (select * from hits1 union all select * from hits2) h on a.q = h.q""",
    "hits2",
)
_oracle(
    "stream_thread_join",
    """select p.event_id error_id, r.event_id reply_id from events r join events p
  on r.user_id = p.user_id and r.ts >= p.ts and r.ts <= p.ts + interval 2 hours
  where r.event_type = 'click' and p.event_type = 'error'""",
)
_oracle(
    "stream_dedup_reply",
    "select distinct user_id || '-' || strftime(ts, '%Y%m%d') parent_ref from events",
)
_part(
    "sessions",
    """
  with l as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 0 else 1 end st from events),
  s as (select *, sum(st) over (partition by user_id order by ts, event_id) session_no from l)
  select user_id, cast(session_no as bigint) session_no, count(*) n, min(ts) a, max(ts) z from s group by user_id, session_no""",
)
_oracle("fragment_sessions", "select user_id, session_no, n from sessions", "sessions")
_CLOSED = "(select max(ts) - interval 10 minutes from events)"
_oracle(
    "stream_fragment_sessions",
    f"""select user_id, strftime(date_trunc('second', a), '%Y-%m-%d %H:%M:%S') session_start, n from sessions
  where z + interval 30 minutes <= {_CLOSED}""",
    "sessions",
)
_oracle(
    "stream_volume",
    f"""select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n from events
  where date_trunc('hour', ts) + interval 1 hour <= {_CLOSED} group by event_type, date_trunc('hour', ts)""",
)
_oracle(
    "stream_turn_state",
    """select user_id, event_id, n turn_no, n >= 3 turn_trigger from (
  select *, row_number() over (partition by user_id order by ts, event_id) n from events)
  where date_trunc('milliseconds', ts) <= date_trunc('milliseconds', (select max(ts) from events)) - interval 10 minutes""",
)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
