"""The registered queries as SQL for another engine, written on their own.

Only the fixed values (word lists and wordings) come from the library; patterns and rules are
stated again, so that a slip in the library shows up as a difference.
"""

from opinionloom.functions import vocab

ORACLE = {}

SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def clean(text):
    steps = [
        (rf"http[^{SPACE}]+|www\.[^{SPACE}]+", ""),
        (r"<[^\n]*?>", ""),
        (r"[^\p{L}\p{N}_,." + SPACE + "]", ""),
        (f"[{SPACE}]+", " "),
    ]
    out = text
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"coalesce(regexp_replace(trim({out}), '\\.{{2,}}', '.', 'g'), '')"


def strip(text):
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def junk(text):
    tokens = f"string_split_regex(lower({text}), '[{SPACE}]+')"
    letters = r"length(regexp_replace(%s, '[^\p{L}]', '', 'g'))" % text
    alnum = r"length(regexp_replace(%s, '[^\p{L}\p{N}]', '', 'g'))" % text
    return (
        f"(len(list_filter({tokens}, lambda w: w not in ('lol', 'ok', 'k', 'plz', 'xd', ''))) = 0"
        f" or {letters} < 3 or {alnum} / length({text}) < 0.3)"
    )


def words(text):
    return r"string_split_regex(regexp_replace(lower(%s), '[^\p{L}\p{N}_%s]', '', 'g'), '[%s]+')" % (text, SPACE, SPACE)


def rounded(value, digits):
    return f"(round_even(({value}) * {10**digits}, 0) / {10**digits}.0)::double"




def sql_list(values):
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"

REVIEWS = "reviews as (select doc_id as review_id, source as model, text as original_review, lang from documents)"
CLEANED = f"""{REVIEWS},
cleaned_all as (select *, {clean('original_review')} as c from reviews),
cleaned as (select review_id, model, lang, case when {junk('c')} then null else c end as cleaned_review from cleaned_all)"""


def deduped(group):
    return f"""
keyed as (select *, coalesce({strip('lower(cleaned_review)')}, 'nan') as norm_review from cleaned),
ranked as (select *, row_number() over (partition by {group}, norm_review order by review_id) as rn from keyed),
final as (select review_id, model, lang, norm_review, cleaned_review,
                 case when rn = 1 then cleaned_review end as final_review from ranked)"""


KNOWN = """known as (select doc_id as review_id,
    (case when toxic = 1 then 1 when quality = 1 then 5 else 3 end)::double as sentiment_score,
    case when toxic = 1 then 'Negative' when quality = 1 then 'Positive' else 'Neutral' end as sentiment_label
  from labels)"""
FINAL = f"{CLEANED},{deduped('model')}"
SCORED = f"""{FINAL}, {KNOWN},
scored as (select f.*, case when final_review <> '' then k.sentiment_score end as sentiment_score,
                  case when final_review <> '' then k.sentiment_label end as sentiment_label
           from final f left join known k using (review_id))"""

GOOD = "('the', 'and', 'with', 'pour', 'und', 'los')"
BAD = "('that', 'from', 'der', 'que', 'les', 'was')"


NO_WORD = r"[^\p{L}\p{N}_]"


def lexicon(text, rows, keep):
    """Rows with the raw label and confidence of the word lists."""
    return f"""
counted as (select {keep}, {text} as scored_text,
   len(list_filter(string_split_regex(lower({text}), '{NO_WORD}'), lambda w: w in {GOOD})) as good,
   len(list_filter(string_split_regex(lower({text}), '{NO_WORD}'), lambda w: w in {BAD})) as bad from {rows}),
judged as (select * exclude (scored_text, good, bad),
   case when scored_text is null then null when good > bad then 'Positive' when bad > good then 'Negative'
        else 'Neutral' end as raw_label,
   case when scored_text is null then null
        when good + bad > 0 then greatest(good, bad)::double / (good + bad) else 0.0 end as confidence
 from counted)"""


# Cleaning

ORACLE["clean_documents"] = f"select doc_id as review_id, {clean('text')} as cleaned from documents"
ORACLE["clean_pages"] = f"select page_id, {clean('html')} as cleaned from pages"
ORACLE["reject_meaningless"] = f"with {CLEANED} select review_id, model, cleaned_review from cleaned"
ORACLE["quality_report"] = f"""with {FINAL} select count(*) as total_reviews,
  count(*) filter (where cleaned_review is null) as meaningless_reviews,
  (select count(*) from ranked where rn > 1) as repeated_reviews from final"""
ORACLE["translate_identity"] = f"""with {CLEANED} select review_id, cleaned_review as translated_review,
  cleaned_review as final_review from cleaned"""
ORACLE["translate_foreign"] = f"""with {CLEANED},
sent as (select review_id, lang, {clean("case when lang <> 'en' then 'translated!! ' || cleaned_review else cleaned_review end")} as t from cleaned),
checked as (select review_id, lang, case when {junk('t')} then null else t end as t from sent)
select review_id, lang, t as translated_review, t as final_review from checked"""
ORACLE["dedupe_per_model"] = f"with {FINAL} select review_id, model, norm_review, final_review from final"
ORACLE["dedupe_per_lang"] = f"with {CLEANED},{deduped('lang')} select review_id, lang, final_review from final"
ORACLE["dedupe_conversations"] = f"""with turns as (
  select conv_id * 1048576 + turn as review_id, role as model, text as original_review, null as lang from conversations),
cleaned_all as (select *, {clean('original_review')} as c from turns),
cleaned as (select review_id, model, lang, case when {junk('c')} then null else c end as cleaned_review from cleaned_all),
{deduped('model')} select review_id, model, final_review from final"""
ORACLE["valid_reviews"] = f"""with {FINAL} select review_id, model from final
  where final_review is not null and final_review <> ''"""

# Polarity

RAW = """raw_labels as (select event_id, case event_type
   when 'view' then (event_id % 5 + 1)::varchar || ' stars' when 'click' then 'LABEL_' || (event_id % 6)::varchar
   when 'purchase' then 'Very Positive' when 'error' then 'NEGATIVE' else 'mixed' end as raw from events)"""


def stars(raw):
    return f"""(case when regexp_matches({raw}, '^[0-9]') then regexp_extract({raw}, '^[0-9]+')::double
      when lower({raw}) like '%positive%' then 5 when lower({raw}) like '%negative%' then 1
      when {raw} is not null then 3 end)::double"""


def star_label(score):
    return f"case when {score} <= 2 then 'Negative' when {score} = 3 then 'Neutral' when {score} is not null then 'Positive' end"


def display(raw):
    return f"""case when regexp_matches(upper({raw}), '4|5|POS') then 'Positive'
      when regexp_matches(upper({raw}), '1|2|NEG') then 'Negative' when {raw} is not null then 'Neutral' end"""


ORACLE["label_map_stars"] = f"""with {RAW}, s as (select event_id, {stars('raw')} as sentiment_score from raw_labels)
select *, {star_label('sentiment_score')} as sentiment_label from s"""
ORACLE["label_map_display"] = f"with {RAW} select event_id, {display('raw')} as sentiment from raw_labels"
ORACLE["score_lexicon"] = f"""with {FINAL}, {lexicon("nullif(final_review, '')", 'final', 'review_id')},
s as (select review_id, {stars('raw_label')} as sentiment_score from judged)
select *, {star_label('sentiment_score')} as sentiment_label from s"""
ORACLE["score_plugged"] = f"""with {FINAL},
s as (select review_id, case when final_review <> '' then (length(final_review) % 5 + 1)::double end as sentiment_score from final)
select *, {star_label('sentiment_score')} as sentiment_label from s"""


def overall(text, rows, keep):
    return f"""{lexicon(f"case when {strip(text)} <> '' then {text} end", rows, keep)}
select * exclude (raw_label, confidence), raw_label as overall_raw, {display('raw_label')} as overall_sentiment,
  round_even(confidence, 4)::double as overall_confidence from judged"""


ORACLE["overall_scores"] = "with " + overall("text", "documents", "doc_id, lang")
ORACLE["overall_join"] = f"""with {KNOWN} select d.doc_id as review_id, source, n_chars, sentiment_score, sentiment_label
  from documents d left join known k on k.review_id = d.doc_id"""

# Aspects

TERMS = ["thin", "ment", "ung", "tion", "heat", "eau", "ción", "os", "able", "sch", "the and"]
TERM_LIST = sql_list(TERMS)
SENTENCES = f"""
cut as (select review_id, model, sentiment_label,
   list_filter(list_transform(string_split(regexp_replace(final_review, '([.!?])[{SPACE}]+', '\\1\n', 'g'), '\n'),
                              lambda s: {strip('s')}), lambda s: s <> '') as ss
 from scored where final_review is not null and final_review <> ''),
sentences as (select review_id, model, sentiment_label, unnest(ss) as text, unnest(range(len(ss)))::int as sent_pos from cut),
found as (select *, list_filter({TERM_LIST}, lambda t: contains(lower(text), t)) as hits from sentences)"""
ABSA = f"""{SCORED},{SENTENCES},
absa as (select review_id, model as model_name, sent_pos, text, coalesce(sentiment_label, 'Neutral') as label,
    unnest(hits) as aspect, unnest(range(len(hits)))::int as aspect_ord from found)"""

ORACLE["absa_rows"] = f"with {ABSA} select review_id, sent_pos, aspect_ord, aspect, label, model_name, text from absa"
ORACLE["absa_sentence_labels"] = f"""with {SCORED},{SENTENCES},
own as (select *, case when length(text) % 7 = 0 then null else length(text) % 5 + 1 end as n from found)
select review_id, sent_pos, unnest(hits) as aspect,
   coalesce({star_label('n')}, sentiment_label, 'Neutral') as label from own"""

ASPECT_OF_CLAUSE = (
    "list_sort(["
    + ", ".join(
        f"{{'h': len(list_filter({sql_list(k)}, lambda p: contains(lower(clause), p))), 'r': {-i}, 'a': '{name}'}}"
        for i, (name, k) in enumerate(vocab.ASPECT_KEYWORDS.items())
    )
    + "], 'DESC')[1]"
)
ORACLE["vocabulary_matches"] = f"""select doc_id, t.term from documents join
  (select distinct unnest({sql_list(sum(vocab.ASPECT_KEYWORDS.values(), []))}) as term) t on contains(lower(text), t.term)"""
ORACLE["vocabulary_table_matches"] = r"""select doc_id, t.term from documents join
  (select distinct unnest(string_split_regex(lower(text), '[^\p{L}]+')) as term from benchmark) t on t.term <> '' and contains(lower(text), t.term)"""
# The data has no accented letter next to the three words, so plain word boundaries do.
CLAUSES = f"""
parts as (select doc_id, list_filter(list_transform(
    string_split_regex(text, '(?i)\\bbut\\b|\\bhowever\\b|\\bthough\\b|[.!?]'), lambda s: {strip('s')}), lambda s: s <> '') as cs
  from documents),
clauses as (select doc_id, unnest(cs) as clause, unnest(range(len(cs)))::int as clause_pos from parts)"""
ORACLE["clause_split"] = f"with {CLAUSES} select doc_id, clause_pos, clause from clauses"
CLAUSE_ASPECTS = f"""{CLAUSES},
{lexicon('clause', 'clauses', 'doc_id, clause_pos, clause')},
best as (select *, {ASPECT_OF_CLAUSE} as b from judged),
clause_aspects as (select doc_id as review_index, clause_pos, clause, case when b.h > 0 then b.a else 'Other' end as aspect,
   {display('raw_label')} as sentiment, raw_label, round_even(confidence, 4)::double as confidence from best)"""
ORACLE["clause_aspects"] = f"with {CLAUSE_ASPECTS} select * from clause_aspects"
ORACLE["clause_csv"] = f"""with {CLAUSE_ASPECTS} select review_index, clause_pos, clause, aspect,
  sentiment, raw_label, confidence from clause_aspects"""
ORACLE["clause_preview"] = f"""with {CLAUSE_ASPECTS} select * from clause_aspects order by review_index, clause_pos limit 100"""
ORACLE["aspect_pivot"] = f"""with {CLAUSE_ASPECTS},
n as (select aspect, count(*) filter (where sentiment = 'Positive') as "Positive",
   count(*) filter (where sentiment = 'Neutral') as "Neutral", count(*) filter (where sentiment = 'Negative') as "Negative",
   count(*) as "Total" from clause_aspects group by aspect)
select *, {rounded('"Positive" / "Total" * 100', 1)} as "Positive_pct", {rounded('"Neutral" / "Total" * 100', 1)} as "Neutral_pct",
   {rounded('"Negative" / "Total" * 100', 1)} as "Negative_pct" from n"""
ORACLE["insight_lines"] = f"""with {CLAUSE_ASPECTS},
told as (select review_index, sentiment, aspect, string_agg(clause, '; ' order by clause_pos) as t
   from clause_aspects where sentiment <> 'Neutral' group by all),
lines as (select review_index, (row_number() over (partition by review_index order by sentiment desc, aspect) - 1)::int as line_no,
   case sentiment when 'Positive' then '✅ **' else '⚠️ **' end || aspect || '**: ' || t as line from told)
select * from lines union all
select doc_id, 0, 'Overall tone is neutral with no strong praise or complaints detected.' from documents
 where doc_id not in (select review_index from told)"""
# A review without any clause has no row in the clause table.
ORACLE["insight_lines_gathered"] = (
    ORACLE["insight_lines"] + " and doc_id in (select review_index from clause_aspects)"
)
CROSSTAB = f"""{ABSA}, top8 as (select aspect, count(*) as total from absa group by aspect order by total desc, aspect limit 8)"""
ORACLE["aspect_crosstab_top8"] = f"""with {CROSSTAB} select aspect,
  count(*) filter (where label = 'Negative') / count(*) * 100 as "Negative",
  count(*) filter (where label = 'Neutral') / count(*) * 100 as "Neutral",
  count(*) filter (where label = 'Positive') / count(*) * 100 as "Positive"
 from absa where aspect in (select aspect from top8) group by aspect"""
ORACLE["rows_of_top_aspects"] = f"""with {CROSSTAB} select review_id, sent_pos, aspect, label from absa
  where aspect in (select aspect from top8)"""

# Statistics


def keywords(rows, group, n):
    keys = f"{group}, " if group else ""
    over = f"partition by {group} " if group else ""
    return f"""
split_words as (select *, {words('final_review')} as ws from {rows}),
used as (select {keys}review_id, unnest(ws) as word, unnest(range(len(ws))) as pos from split_words),
counted_words as (select {keys}word, count(*) as uses, min(review_id::hugeint * 2147483648 + pos) as first_place from used
   where length(word) > 2 and not list_contains({sql_list(vocab.STOP_WORDS)}, word) group by all),
ranked_words as (select *, row_number() over ({over}order by uses desc, first_place)::int as rank from counted_words),
top_words as (select * from ranked_words where rank <= {n})"""


def model_figures(valid):
    share = f"case when {valid} > 0 then {{}} / {valid} * 100 else 0 end"
    return f"""{SCORED},{keywords("(select * from scored where sentiment_label in ('Positive', 'Negative'))", 'model, sentiment_label', 6)},
kw as (select model, string_agg(word, ', ' order by rank) filter (where sentiment_label = 'Positive') as p,
   string_agg(word, ', ' order by rank) filter (where sentiment_label = 'Negative') as n from top_words group by model),
c as (select model, count(*) as total, count(sentiment_label) as labelled,
   count(*) filter (where sentiment_label = 'Positive') as pos, count(*) filter (where sentiment_label = 'Negative') as neg,
   count(*) filter (where sentiment_label = 'Neutral') as neu, avg(sentiment_score) as mean, min(review_id) as first_review
   from scored where model is not null group by model),
figures as (select model, total as total_reviews, {valid} as valid_cleaned_reviews,
   {rounded(share.format('pos'), 2)} as pct_positive, {rounded(share.format('neg'), 2)} as pct_negative,
   {rounded(share.format('neu'), 2)} as pct_neutral, coalesce({rounded('mean', 2)}, 0) as average_sentiment_score,
   coalesce(p, '') as top_6_positive_keywords, coalesce(n, '') as top_6_negative_keywords, first_review
   from c left join kw using (model))"""


ORACLE["model_stats"] = f"with {model_figures('labelled')} select * exclude (first_review) from figures"
ORACLE["model_stats_all_rows"] = f"with {model_figures('total')} select * exclude (first_review) from figures"
ORACLE["model_keywords"] = f"""with {SCORED},{keywords('(select * from scored where sentiment_label is not null)', 'model, sentiment_label', 6)}
select * exclude (first_place) from top_words"""
ORACLE["top_keywords_overall"] = f"""with {SCORED},{keywords('(select * from scored where sentiment_label is not null)', '', 10)}
select word, uses from top_words"""


def kpi(where):
    return f"""with {SCORED}, k as (select count(*) as total_reviews, avg(sentiment_score) as average_rating,
  count(*) filter (where sentiment_label = 'Positive') / count(*) * 100 as positive_pct,
  count(*) filter (where sentiment_label = 'Negative') / count(*) * 100 as negative_pct from scored {where})
select *, format('{{:,}}', total_reviews) as total_reviews_text, printf('%.1f', average_rating) || ' ★' as average_rating_text,
  printf('%.1f', positive_pct) || '%' as positive_text, printf('%.1f', negative_pct) || '%' as negative_text from k"""


ORACLE["kpi_row"] = kpi("")
ORACLE["kpi_one_model"] = kpi("where model = 'src0'")
ORACLE["label_distribution"] = f"""with {SCORED} select sentiment_label, count(*) as n from scored
  where sentiment_label is not null group by 1"""
ORACLE["star_distribution"] = f"""with {SCORED} select sentiment_score, count(*) as n from scored
  where sentiment_score is not null group by 1"""
ORACLE["label_by_model"] = f"""with {SCORED} select model, sentiment_label, count(*) as n from scored
  where sentiment_label is not null group by 1, 2"""
ORACLE["model_list"] = "select source as model from documents union select role from conversations order by 1"

ADVICE = ", ".join(
    "case when " + " or ".join(f"contains(lower(top_6_negative_keywords), '{word}')" for word in words)
    + f" then '{line}' end"
    for words, line in vocab.ADVICE_RULES
)
FEEDBACK = rf"""{model_figures('labelled')},
sections as (select model, first_review,
  '6.1 Summary' || chr(10) || 'The overall sentiment for ' || model || ' is ' ||
    case when pct_positive > 75 then 'overwhelmingly positive' when pct_positive > 50 then 'generally positive'
         when pct_positive > 30 then 'mixed' else 'largely negative' end ||
    '. Analysis shows a breakdown of ' || pct_positive || '% Positive, ' || pct_negative || '% Negative, and ' || pct_neutral ||
    '% Neutral sentiment. ' || case when valid_cleaned_reviews > 50 then 'High review volume with diverse opinions'
         else 'Low to moderate volume—insights may be limited' end || '.' as summary,
  '6.2 Strengths' || chr(10) || case when top_6_positive_keywords <> ''
    then 'Customers frequently praised key aspects such as: ' || top_6_positive_keywords || '.'
    else 'No specific praise themes detected.' end as strengths,
  '6.3 Weaknesses' || chr(10) || 'Critical areas for improvement include ' || case when top_6_negative_keywords <> ''
    then 'recurring complaints focused on: ' || top_6_negative_keywords || '.'
    else 'No specific complaint themes detected.' end as weaknesses,
  list_filter([{ADVICE}],
   lambda x: x is not null) as called_for from figures),
advised as (select *, list_concat(called_for, {sql_list(vocab.DEFAULT_ADVICE)}[1:greatest(3 - len(called_for), 0)]) as advice from sections),
feedback as (select model, first_review, summary, strengths, weaknesses,
   '6.4 Actionable Recommendations' || chr(10) || list_aggregate(list_transform(advice, lambda a: '- ' || a), 'string_agg', chr(10)) as recommendations
   from advised)"""
FULL = "summary || repeat(chr(10), 2) || strengths || repeat(chr(10), 2) || weaknesses || repeat(chr(10), 2) || recommendations"
ORACLE["feedback_report"] = f"with {FEEDBACK} select * exclude (first_review), {FULL} as full_report_text from feedback"
ORACLE["stats_preview"] = f"with {model_figures('labelled')} select * from figures order by first_review limit 10"
TITLE = "select 0 as part, 0::bigint as place, '# Manufacturer Feedback Report' || chr(10) as value"
ORACLE["report_markdown"] = f"""with {FEEDBACK} {TITLE} union all select 1, first_review,
  '## Model: ' || model || chr(10) || {FULL} || chr(10) || chr(10) || '---' || chr(10) from feedback"""
ORACLE["report_sections"] = f"""with {FEEDBACK} {TITLE} union all select 1, first_review,
  '## Model: ' || model || chr(10) || '**Summary**: ' || summary || chr(10) || chr(10) || '**Strengths**: ' || strengths || chr(10) || chr(10)
  || '**Weaknesses**: ' || weaknesses || chr(10) || chr(10) || '**Recommendations**: ' || recommendations || chr(10) || chr(10) || '---' || chr(10)
  from feedback"""

# Business summaries

RECORDS = f"""{ABSA}, numbered as (select *, row_number() over (partition by model_name order by review_id, sent_pos, aspect_ord) - 1 as i
  from absa where model_name is not null),
records as (select model_name as model, i::int as review_id, text as review_text, aspect, lower(label) as sentiment,
  0.95::double as confidence from numbered where i < 100)"""
ORACLE["first_records"] = f"with {RECORDS} select * from records"
ORACLE["bi_payload"] = f"""with {RECORDS} select model, to_json(list({{'review_id': review_id, 'review_text': review_text,
  'aspect': aspect, 'sentiment': sentiment, 'confidence': confidence}} order by review_id))::varchar as payload from records group by model"""
SHARES = f"""{ABSA}, shares as (select model_name as model, aspect, count(*) as mentions,
  avg((label = 'Positive')::int) as positive_share, avg((label = 'Negative')::int) as negative_share
  from absa where model_name is not null group by 1, 2),
rated as (select *, case when negative_share >= 0.5 then 'HIGH' when negative_share >= 0.25 then 'MEDIUM' else 'LOW' end as priority from shares)"""
ORACLE["aspect_shares"] = f"with {SHARES} select * from rated"
SUMMARY = f"""with {SHARES},
lines as (
 select model, 1 as block, 0.0::double as o1, '' as o2, 'overview' as section, null as title, null as priority,
   model || ': ' || sum(mentions)::bigint || ' mentions of ' || count(*) || ' aspects, ' ||
   count(*) filter (where positive_share >= 0.5) || ' strengths and ' || count(*) filter (where negative_share > 0) || ' issues.' as text,
   null as note from rated group by model
 union all select model, 2, -positive_share, aspect, 'strength', aspect, null,
   printf('%.1f', positive_share * 100) || '% of ' || mentions || ' mentions are positive.',
   'Positive: ' || positive_share || ' • Negative: ' || negative_share from rated where positive_share >= 0.5
 union all select model, 3, -negative_share, aspect, 'issue', aspect, priority,
   printf('%.1f', negative_share * 100) || '% of ' || mentions || ' mentions are negative.',
   'Negative: ' || negative_share || ' • Positive: ' || positive_share from rated where negative_share > 0
 union all select model, 4, -negative_share, aspect, 'recommendation', 'Improve ' || aspect, null,
   printf('%.1f', negative_share * 100) || '% of ' || mentions || ' mentions are negative.',
   'Fewer complaints about ' || aspect from rated where negative_share >= 0.25)
select model, (row_number() over (partition by model order by block, o1, o2) - 1)::int as line_no, section, title, priority, text, note from lines"""
ORACLE["bi_summary"] = SUMMARY
ONLY_NEGATIVE = SUMMARY.replace("from absa where model_name is not null", "from absa where model_name is not null and label = 'Negative'", 1)
ORACLE["published_summaries"] = f"""select * from ({SUMMARY}) where model like 'src1%'
  union all select * from ({ONLY_NEGATIVE}) where model not like 'src1%'"""
ORACLE["find_summary"] = f"select * from ({SUMMARY}) where model = 'src1'"
ORACLE["upsert_summary"] = f"""with {SCORED},
stored as (select model || '-' || lang as model, count(*) as reviews, min(review_id) as first_review from scored
  where sentiment_label = 'Negative' group by 1),
news as (select model || '-' || lang as model, count(*) as reviews, avg(sentiment_score) as average from scored
  where sentiment_label = 'Positive' group by 1)
select model, coalesce(n.reviews, s.reviews) as reviews, s.first_review, n.average from stored s full join news n using (model)"""

# Training and vectors

SPLIT = f"""{ABSA}, pairs as (select *, case label when 'Negative' then 0 when 'Neutral' then 1 else 2 end as label_id,
  case when substr(md5(review_id || '|' || sent_pos || '|' || aspect), 1, 4) < '3333' then 'validation' else 'train' end as split from absa)"""
ORACLE["training_split"] = f"with {SPLIT} select review_id, sent_pos, aspect, label, label_id, split from pairs"
ORACLE["classifier_metrics"] = f"""with {SPLIT}, {lexicon('text', 'pairs', 'label_id')},
p as (select label_id as l, case raw_label when 'Negative' then 0 when 'Neutral' then 1 else 2 end as m from judged),
per_class as (select k, (select count(*) from p where l = k) as support, (select count(*) from p where m = k) as said,
   (select count(*) from p where l = k and m = k) as hits from (select unnest([0, 1, 2]) as k)),
r as (select *, case when said > 0 then hits / said else 0 end as pr, case when support > 0 then hits / support else 0 end as re from per_class),
f as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f1 from r)
select round(sum(hits) / sum(support), 10) as accuracy, round(sum(f1 * support) / sum(support), 10) as f1,
   round(sum(pr * support) / sum(support), 10) as precision, round(sum(re * support) / sum(support), 10) as recall from f"""
ORACLE["embedded_documents"] = f"""with {SCORED} select final_review as review_text, 256 as dimensions, coalesce(model, 'Unknown') as model,
  coalesce(sentiment_label, 'Neutral') as sentiment_label, coalesce(sentiment_score, 0) as sentiment_score, review_id as original_index
  from scored where {strip('final_review')} <> ''"""
ORACLE["embed_reviews"] = f"""with {SCORED},
given as (select review_id, coalesce(model, 'Unknown') as model, unnest(list_filter({words('final_review')}, lambda w: w <> '')) as word
  from scored where {strip('final_review')} <> ''),
texts as (select count(*) as n from scored where {strip('final_review')} <> ''),
hashed as (select review_id, model, (('0x' || substr(md5(word), 1, 8))::bigint % 256)::int as place, count(*) as uses from given group by all),
weight as (select place, floor(1000 * ln(((select n from texts) + 1) / (count(*) + 1)) + 0.5)::bigint as w from hashed group by place),
part as (select review_id, model, place, uses * w as v from hashed join weight using (place))
select review_id as original_index, model, place, (v / sqrt((sum(v * v) over (partition by review_id))::double))::float::double as value
from part where v <> 0"""
ORACLE["train_classifier"] = f"with {SPLIT} select split, label, count(*) as n_rows, count(*) as predicted from pairs group by 1, 2"
ORACLE["retrained_stats"] = f"""with {SCORED} select model, count(*) as total_reviews,
  count(*) filter (where final_review <> '') as valid_cleaned_reviews, 100 as percent, min(review_id) as first_review
  from scored where model is not null group by model"""
ORACLE["vector_topk"] = """with probes as (select label, arg_min(embedding, vec_id) as probe from embeddings group by label),
s as (select e.label, vec_id, list_cosine_similarity(embedding::double[], probe::double[]) as sim from embeddings e join probes using (label)),
r as (select *, row_number() over (partition by label order by sim desc, vec_id)::int as rank from s)
select label, vec_id, round(sim, 6) as similarity, rank from r where rank <= 10"""
ORACLE["vector_search"] = """with asked as (
  select 0 as query_id, list_transform(range(64), lambda i: 1.0::double) as q union all
  select 1, list_transform(range(64), lambda i: (i % 2)::double) union all
  select 2, list_transform(range(64), lambda i: i::double)),
s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], q) as sim from embeddings, asked),
r as (select *, row_number() over (partition by query_id order by sim desc, vec_id)::int as rank from s)
select query_id, vec_id, round(sim, 6) as similarity, rank from r where rank <= 10"""
ORACLE["vector_search_lists"] = ORACLE["vector_search"]
ORACLE["upsert_vectors"] = """with a as (select 'label' || label as model, vec_id * 2 as original_index, len(embedding)::int as dimensions from embeddings),
s as (select 'label' || label as model, vec_id as original_index from embeddings)
select model, original_index, case when dimensions is null then 'stored' else 'arrived' end as state, dimensions
from s full join a using (model, original_index)"""

ORACLE["keyed_embeddings"] = """select coalesce(a.vec_id, b.vec_id + 100) as vec_id, label, len(embedding)::int as dimensions,
  case when b.vec_id is null then 1 else 2 end as round from embeddings a full join (select vec_id from embeddings) b on a.vec_id = b.vec_id + 100"""

# Files

MISSING = f"case when list_contains({sql_list(vocab.NA_STRINGS)}, {{0}}) then null else {{0}} end"
ORACLE["csv_reviews"] = f"""select doc_id as review_id, {MISSING.format('source')} as model,
  {MISSING.format('text')} as original_review from documents"""
ORACLE["csv_numbered"] = f"""select row_number() over (order by doc_id) - 1 as review_id, {MISSING.format('source')} as model,
  {MISSING.format('text')} as original_review from documents"""
ORACLE["csv_parallel"] = ORACLE["csv_numbered"]
ORACLE["uploaded_csv"] = f"""with up as (select doc_id::varchar as review_id, lang as "a.b", text, {MISSING.format('text')} as _review_text from documents),
  {overall('_review_text', 'up', 'review_id, "a.b", text, _review_text')}"""
LEXICON_RUN = f"""{FINAL}, {lexicon("nullif(final_review, '')", 'final', 'review_id')},
scored_by_words as (select final.*, {stars('raw_label')} as sentiment_score, raw_label as sentiment_label from final join judged using (review_id))"""


def lexicon_figures():
    return model_figures("labelled").replace(SCORED, LEXICON_RUN, 1).replace("from scored where", "from scored_by_words where")


ORACLE["full_run"] = f"with {lexicon_figures()} select * exclude (first_review) from figures"
ORACLE["stored_results"] = f"""with {LEXICON_RUN} select model, sentiment_label, count(*) as n from scored_by_words
  where sentiment_label is not null group by 1, 2"""

TRANSLATED = f"""{CLEANED},
sent as (select review_id, model, {clean("case when lang <> 'en' then 'translated!! ' || cleaned_review else cleaned_review end")} as t from cleaned),
translated as (select review_id, model, null as lang, case when {junk('t')} then null else t end as cleaned_review from sent)"""
ORACLE["run_translated"] = f"""with {TRANSLATED},{deduped('model').replace('from cleaned)', 'from translated)')},
{lexicon("nullif(final_review, '')", 'final', 'review_id')}
select review_id, model, cleaned_review as translated_review, final_review, raw_label as sentiment_label from final join judged using (review_id)"""


def letter_runs(texts, key):
    """(key, bucket, n): the buckets of runs of three letters in a relation's texts."""
    return f"""(select {key}, (unicode(s[i:i]) * 961 + unicode(s[i + 1:i + 1]) * 31 + unicode(s[i + 2:i + 2])) % 8191 as bucket, sum(n)::bigint as n
  from (select {key}, n, ' ' || word || ' ' as s, unnest(range(1, length(word) + 1)) as i from (
    select {key}, word, count(*) as n from (select {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) as word from {texts})
    group by all)) group by all)"""


def languages(texts, key):
    """CTEs: the profile of the documents' languages, and ``spoken``, the language of each text of a relation."""
    return f"""runs_of_languages as {letter_runs('(select lang, text from documents where lang is not null)', 'lang')},
totals as (select lang, sum(n) + 8191 as total from runs_of_languages group by lang),
runs_of_texts as {letter_runs(texts, key)},
fits as (select r.{key}, t.lang as spoken, sum(r.n * floor(1000 * ln((coalesce(c.n, 0) + 1) / t.total) + 0.5))::bigint as score
  from runs_of_texts r cross join totals t left join runs_of_languages c on c.lang = t.lang and c.bucket = r.bucket group by all),
spoken as (select {key}, case when count(*) > 1 then 'unknown' else min(spoken) end as detected
  from (select *, max(score) over (partition by {key}) as best from fits) where score = best group by {key})"""


ORACLE["detect_language"] = f"""with {languages('documents', 'doc_id')}
select doc_id, lang, coalesce(detected, 'unknown') as detected from documents left join spoken using (doc_id)"""
DETECTED = f"""{CLEANED},
{languages('(select review_id, cleaned_review as text from cleaned)', 'review_id')},
sent as (select review_id, model, {clean("case when coalesce(detected, 'unknown') not in ('en', 'unknown') then 'translated!! ' || cleaned_review else cleaned_review end")} as t
  from cleaned left join spoken using (review_id)),
translated as (select review_id, model, null as lang, case when {junk('t')} then null else t end as cleaned_review from sent)"""
ORACLE["run_detected"] = f"""with {DETECTED},{deduped('model').replace('from cleaned)', 'from translated)')},
{lexicon("nullif(final_review, '')", 'final', 'review_id')}
select review_id, model, cleaned_review as translated_review, final_review, raw_label as sentiment_label from final join judged using (review_id)"""

ABBREVIATIONS = r"""counted as (
  select rtrim(t, '.') as word, count(*)::bigint as n, count(*) filter (where length(t) = length(rtrim(t, '.')) + 1)::bigint as stopped
  from (select unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{N}.]*')) as t from documents) group by all),
usual as (select sum(stopped) / sum(n) as share from counted),
scored_words as (select word, n, stopped, length(word) - length(replace(word, '.', '')) as inner_stops,
  -2 * (stopped * ln(share) + (n - stopped) * ln(1 - share) - stopped * ln(0.99) - (n - stopped) * ln(1 - 0.99)) as ratio
  from counted, usual where stopped > 0 and length(word) <= 20 and share > 0 and share < 1),
abbreviations as (select word, n, stopped, ratio * exp(-(length(word) - inner_stops)) * (inner_stops + 1)
    * pow((length(word) - inner_stops)::double, stopped - n) as score from scored_words),
short as (select word from abbreviations where score >= 0.3 order by round(score, 9) desc, word limit 2000)""".replace("\\\\", "\\")
ORACLE["learned_abbreviations"] = f"with {ABBREVIATIONS} select word, n, stopped, round(score, 6) as score from abbreviations where score >= 0.3"
BLANK = SPACE.replace(r"\t-\r", r"\t\x{0b}-\r")
ORACLE["sentences_learned"] = rf"""with {ABBREVIATIONS},
cut as (select doc_id, regexp_extract_all(text, '[^\n]*?[.!?][{SPACE}]+|[^\n]+|\n') as ps from documents where text is not null),
piece as (select doc_id, unnest(ps) as p, unnest(range(len(ps))) as i from cut),
held as (select doc_id, p, i,
  lower(regexp_extract(p, '(?:^|[^\p{{L}}\p{{N}}.])(\p{{L}}[\p{{L}}\p{{N}}.]*)\.[{BLANK}]+$', 1)) in (select word from short) as goes_on from piece),
part as (select *, coalesce(sum((not goes_on)::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as g from held),
joined as (select doc_id, g, {strip("string_agg(p, '' order by i)")} as text from part group by doc_id, g)
select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as sent_pos, text from joined where text <> ''"""
ORACLE["reloaded_first_records"] = f"with {RECORDS} select * from records where review_id < 5"
ORACLE["reloaded_model_stats"] = f"with {model_figures('labelled')} select * from figures"
ORACLE["plain_aspect_file"] = """with r as (select source as model, doc_id, row_number() over (partition by source order by doc_id) - 1 as i from documents)
select model, i::int as review_id, 'text ' || doc_id as review_text, 'price' as aspect, 'positive' as sentiment, 0.95::double as confidence
from r where i < 5 and model is not null"""

# Streams

STARS = f"""e as (select *, floor(value % 5)::double + 1 as sentiment_score from events),
arrived as (select *, {star_label('sentiment_score')} as sentiment_label from e)"""
ORACLE["live_kpi"] = f"""with {STARS},
w as (select date_trunc('day', ts) as window_start, event_type, count(*) as total_reviews, avg(sentiment_score) as average_rating,
  count(*) filter (where sentiment_label = 'Positive') / count(*) * 100 as positive_pct,
  count(*) filter (where sentiment_label = 'Negative') / count(*) * 100 as negative_pct from arrived group by 1, 2)
select window_start::timestamp as window_start, (window_start + interval 1 day)::timestamp as window_end, * exclude (window_start) from w
where window_start + interval 1 day <= (select max(ts) - interval 1 hour from events)"""
ORACLE["run_quality"] = ORACLE["quality_report"]
ORACLE["model_keywords_sketched"] = ORACLE["model_keywords"]
ORACLE["live_windows"] = ORACLE["live_kpi"].split("where window_start +")[0] + "where window_start is not null"
ORACLE["live_corrections"] = f"""with {STARS},
b as (select time_bucket(interval 10 day, ts, timestamp '1970-01-01') as window_start, event_type, sentiment_score, sentiment_label, ts,
  case when day(ts) < 9 then 0 when day(ts) >= 25 then 1 when day(ts) >= 17 then 2 else 3 end as batch from arrived where ts is not null),
clock as (select batch, max(last) over (order by batch) as now_at, max(last) over (order by batch rows between unbounded preceding and 1 preceding) as before
  from (select batch, max(ts) as last from b group by batch)),
touched as (select distinct window_start, event_type, batch from b),
upto as (select t.window_start, t.event_type, t.batch, count(*) as total_reviews, avg(sentiment_score) as average_rating,
  count(*) filter (where sentiment_label = 'Positive') / count(*) * 100 as positive_pct,
  count(*) filter (where sentiment_label = 'Negative') / count(*) * 100 as negative_pct
  from touched t join b on b.window_start = t.window_start and b.event_type is not distinct from t.event_type and b.batch <= t.batch group by 1, 2, 3)
select window_start::timestamp as window_start, (window_start + interval 10 day)::timestamp as window_end, event_type,
  (row_number() over (partition by window_start, event_type order by batch))::int as revision,
  case when window_start + interval 10 day + interval 1 hour <= before then 'correction'
    when window_start + interval 10 day + interval 1 hour <= now_at then 'closed' else 'open' end as kind,
  total_reviews, average_rating, positive_pct, negative_pct from upto join clock using (batch)"""
ORACLE["stream_dedupe"] = "select distinct user_id, event_type from events"
ORACLE["stream_upsert"] = f"""with {STARS} select user_id, event_type, max(event_id) as event_id,
  arg_max(sentiment_label, event_id) as sentiment_label from arrived group by 1, 2"""
