"""Schemas of the stage tables, as DDL."""

PAPER = ("pub_id string, title string, abstract string, venue string, year int, keywords array<string>, authors array<struct<name:string,org:string>>")
PROFILE = ("aid string, name string, pubs array<string>")
PAIR_SIM = (
    "record_id string, aid string, pub_id string, title_sim double, abstract_sim double, venue_sim double, org_sim double, "
    "coauthor_count int, coauthor_ratio double, coauthor_org_match_count int, year_diff int"
)
FEATURE = ("record_id string, aid string, sim_features array<double>, hand_features array<double>, org_available double, features array<double>, label int, pub_count int")
DECISION = (
    "record_id string, predicted string, confidence string, reasoning string, truth string, num_candidates int, subtype string, strategy string, "
    "top1_title_sim double, top1_coauthor_count int, top1_org_sim double, top1_venue_sim double, estimated_prompt_tokens int"
)
GROUND_TRUTH = ("record_id string, aid string")
EMBEDDING = ("key string, vec array<float>")
