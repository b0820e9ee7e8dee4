"""DuckDB twins of the queries that SQL can express: exact results over whole tables.

There is none for the approximate search, the drawn mix, entropy spans, trained models, xxHash
fingerprints and the tokenizer; tests hold these against brute force, round trips or held-out rows.
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
)

DECONTAMINATE = f"""
with d as materialized (select doc_id, {_WORDS} ws from documents),
b as (select cast(item_id as varchar) item, {_WORDS} ws from benchmark),
items as (select item, ws, least(len(ws), 10) n from b where len(ws) > 0),
windows as materialized (
  select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') g
  from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) i from items)),
own as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') g
        from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i
              from d, (select distinct n from items) where len(ws) >= n)),
hits as materialized (select doc_id, n, i, item from own join windows using (n, g)),
places as (select doc_id, count(*) n_hit from (
             select distinct doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by doc_id),
found as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join places p on d.doc_id = p.doc_id left join found f on d.doc_id = f.doc_id"""

_BITS = " || ".join(f"to_base(cast('0x' || substr(hex, {i}, 1) as int), 2, 4)" for i in range(1, 41))
_LETTERS = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    + " + ".join(f"{16 >> b} * cast(substr(bits, {5 * k + b + 1}, 1) as int)" for b in range(5))
    + ", 1)"
    for k in range(32)
)
WARC = f"""
with p as (select page_id, coalesce(html, '') html from pages),
h as (select page_id, octet_length(encode(html)) n, sha1(html) hex, min(page_id) over (partition by html) first from p),
b as (select *, {_BITS} bits from h)
select page_id, cast(n as bigint) payload_bytes, {_LETTERS} payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from b"""

SUFFIX_DEDUP = """
with t as materialized (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) g
      from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) i from t)),
again as (select g from w group by g having count(*) > 1),
met as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) before
        from w where g in (select g from again)),
marked as (select *, sum(case when i <= before + 200 then 0 else 1 end) over (partition by doc_id order by i) run from met),
runs as materialized (select doc_id, run, min(i) a, max(i) + 200 z from marked group by doc_id, run),
gaps as (
  select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) a, a z from runs
  union all
  select t.doc_id, coalesce(max(z), 0), any_value(length(h) // 2) from t left join runs r on t.doc_id = r.doc_id group by t.doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) k
         from gaps g join t on g.doc_id = t.doc_id group by g.doc_id),
sums as (select doc_id, sum(z - a) n_removed, count(*) n_spans from runs group by doc_id)
select t.doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed,
  coalesce(n_spans, 0) n_spans, sha256(unhex(k)) kept_sha256
from t join kept k on t.doc_id = k.doc_id left join sums s on t.doc_id = s.doc_id"""

COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
grams as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') g
          from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, (select unnest([1, 2, 3, 4, 5]) k))),
f as materialized (select lang, k, g, count(*) a from grams group by lang, k, g having count(*) >= 100),
t as (select lang, sum(len(ws)) n from w group by lang),
c as materialized (select * from f where k > 1),
left_out as (select distinct s.lang, s.g from c s join c q on s.lang = q.lang and q.k > s.k and 100 * q.a >= 100 * s.a
             and contains(' ' || q.g || ' ', ' ' || s.g || ' ')),
cuts as (select c.lang, c.g, c.a, x.a l, y.a r, cast(t.n as bigint) n, j,
           cast((1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as bigint) score
         from (select *, unnest(range(1, k)) j, string_split(g, ' ') ws from c) c join t on c.lang = t.lang
         join f x on x.lang = c.lang and x.k = j and x.g = array_to_string(ws[1 : j], ' ')
         join f y on y.lang = c.lang and y.k = c.k - j and y.g = array_to_string(ws[j + 1 :], ' ')),
low as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, g) rank, g phrase, a, l, r, n, score
from low anti join left_out using (lang, g) qualify rank <= 2000"""

_DRAWS = ", ".join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint) h{i + 1}" for i in range(4))
FILL_IN_MIDDLE = rf"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || cast(doc_id as varchar)) h,
             regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') ws from documents),
e as (select *, cast(len(ws) as bigint) n, {_DRAWS} from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) x, greatest(h1 % (n + 1), h2 % (n + 1)) y,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
             when h4 % 100 < 80 then 'spm' else 'psm' end form from e),
p as (select *, array_to_string(ws[1 : x], '') pre, array_to_string(ws[x + 1 : y], '') mid, array_to_string(ws[y + 1 :], '') suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256
from p"""

NGRAM_JOIN = r"""
with recursive d as (select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (select distinct doc_id, array_to_string(ws[i : i + least(4, len(ws)) - 1], ' ') g
      from (select doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) i from d where len(ws) > 0)),
n as materialized (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) met from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met >= 85 * (x.n + y.n - met)),
reach as (select doc_id node, doc_id root from d union select l.b, r.root from reach r join links l on l.a = r.node)
select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(root) component_id
from d join reach on node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""

ORACLES = {"op1_decontaminate": DECONTAMINATE, "op5_warc_packages": WARC, "op9_suffix_dedup": SUFFIX_DEDUP,
           "op11_collocations": COLLOCATIONS, "op12_fill_in_middle": FILL_IN_MIDDLE,
           "op13_ngram_components": NGRAM_JOIN}
