"""The tables of a reconciliation and the dimension of finding kinds."""

#: Every kind of finding with its priority.
PRIORITY = {
    "ADD_IDENTIFIER": 1,
    "DUPLICATE_IDENTIFIER": 1,
    "DUPLICATE_SOURCE_LINK": 1,
    "REVIEW_ENDED": 1,
    "SOURCES_DISAGREE": 2,
    "ADD_END_DATE": 2,
    "ADD_MEMBERSHIP": 2,
    "FIX_START_DATE": 2,
    "ADD_START_DATE": 3,
    "ADD_TERM": 3,
    "ADD_QUALIFIER": 4,
    "REVIEW_PARTY": 4,
    "NO_WIKIDATA_ITEM": 5,
    "MISSING_IDENTIFIER": 5,
    "ADD_PERSON_DATA": 6,
}
#: Of a kind that no table knows.
OTHER_PRIORITY = 99
#: Kinds that only add what is missing, and those of them that touch an existing statement.
MECHANICAL = ("ADD_MEMBERSHIP", "ADD_START_DATE", "ADD_END_DATE", "ADD_TERM", "ADD_QUALIFIER")
QUALIFIER_ONLY = MECHANICAL[1:]

BODY = "council string, label string, position_qid string"
MEMBERS = (
    "ord long, person_key string, council string, full_name string, active boolean, date_joining date, date_leaving date, tenure_start date, "
    "constituency string, parl_group string, party string, birth_date date, place_of_birth string, website string, "
    "places_of_origin array<string>, occupations array<string>, number_of_children int"
)
#: A resolved member also has these.
RESOLVED = "qid string, qid_source string, duplicate_qids array<string>"
PERIODS = "number int, name string, start date, end date"
ITEMS = "qid string, label string, join_id string, birth_date date, identifiers map<string,string>, parties array<string>, properties array<string>, person_data_known boolean"
STATEMENTS = "ord long, statement_id string, qid string, position_qid string, start date, end date, districts array<string>, groups array<string>, terms array<string>"
TENURES = "person_key string, council string, start date, end date"
SPANS = "qid string, council string, start date, end date, person_ids array<bigint>"
LINK_CONFLICTS = "council string, qid string, person_ids array<bigint>"

#: The union of what findings of all kinds carry; what a kind doesn't have is null.
PAYLOAD = (
    "position string, start date, end date, district string, group string, terms array<string>, biography string, statement_id string, "
    "wikidata_start date, property string, values array<string>, parliament_id string, duplicate_qids array<string>, wikidata_qid string, "
    "source_person_ids array<bigint>, party string, other_start date, other_end date, other_person_ids array<bigint>, "
    "sources_disagree boolean, identifier_unverified boolean, ambiguous_statement boolean"
)
#: ``step``, ``at`` and ``nth`` are where a finding arises: pass, row of the pass, rule; they order ties.
FINDINGS = ("kind", "council", "step", "at", "nth", "member_label", "person_key", "person_qid", "qid_source", "constituency", "parl_group", "detail", "payload")
