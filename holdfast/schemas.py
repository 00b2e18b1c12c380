"""Fixed schemas of the tables that arrive as JSON."""

from __future__ import annotations

from holdfast.functions.rules import RULE_TYPE

SCORE = "struct<rule_id:string,pass:boolean,method:string,detail:string>"
METRICS = (
    "struct<per_rule_pass_rate:double,perfect_success:double,"
    "targeted_rule_success:double,non_target_failure:double>"
)
TURN_RESULT = (
    "struct<turn:int,user_message:string,response:string,attack_targets:array<string>,attack_mode:string,"
    f"compliance_rate:double,response_length:int,metrics:{METRICS},scores:array<{SCORE}>>"
)
RUN_RECORD = (
    "case_id string, rep int, model string, temperature double, "
    "generation_config struct<temperature:double,max_tokens:int>, design_version string, condition string, "
    "rule_count int, turn_count int, target_rule_id string, target_rule_category string, attack_intensity string, "
    "attack_targets array<string>, attack_mode string, attack_order_variant string, attack_order array<string>, "
    "order_average_group_id string, sampled_variant_id string, possible_variant_id string, "
    "rule_set_variant array<string>, judge_status string, timestamp timestamp, "
    f"rules array<{RULE_TYPE}>, turn_results array<{TURN_RESULT}>"
)
TEMPLATE_TURN = (
    "struct<turn:int,role:string,content:string,attack_targets:array<string>,attack_mode:string,attack_type:string,"
    "prompt_id:string,scenario_id:string,attack_strength_level:int>"
)
CASE = (
    "case_id string, design_version string, condition string, rule_count int, turn_count int, target_rule_id string, "
    "target_rule_category string, attack_intensity string, attack_mode string, attack_targets array<string>, "
    "attack_order_variant string, attack_order array<string>, order_average_group_id string, "
    "sampled_variant_id string, possible_variant_id string, rule_set_variant array<string>, "
    f"filler_category_composition map<string,int>, system_prompt string, rules array<{RULE_TYPE}>, "
    f"conversation_template array<{TEMPLATE_TURN}>"
)
CHECKPOINT_KEY = (
    "struct<case_id:string,rep:int,model:string,temperature:double,turn:int,score_index:int,rule_id:string>"
)
JUDGE_CHECKPOINT = f"timestamp timestamp, key {CHECKPOINT_KEY}, score {SCORE}"
MESSAGE = "struct<role:string,content:string>"
CHAT_EXPORT = "id string, conversations array<struct<from:string,value:string>>"
BENCHMARK_CONVERSATION = (
    f"AXIS string, CONVERSATION array<{MESSAGE}>, TARGET_QUESTION string, PASS_CRITERIA string, QUESTION_ID string"
)
INSTRUCTION_PROMPT = "key string, prompt string, instruction_id_list array<string>, kwargs array<map<string,string>>"
SUITE_CASE = f"category string, params map<string,string>, messages array<{MESSAGE}>"
USAGE = (
    "struct<prompt_tokens:long,input_tokens:long,completion_tokens:long,output_tokens:long,total_tokens:long,"
    "reasoning_tokens:long,cost:double>"
)
REQUEST_RECORD = (
    "request_id string, scenario_id string, target_model string, target_rule_id string, target_rule_category string, "
    "target_rule_text string, attack_type string, status string, response string, finish_reason string, "
    f"max_tokens int, temperature double, system_prompt_text string, prompt_text string, usage {USAGE}"
)
PROMPT_COLUMNS = [
    "prompt_id", "annotation_status", "rule_id", "rule_category", "attack_strength_level", "attack_strength_name",
    "attack_strategy", "attack_scope", "prompt_text", "target_rule_summary", "intended_failure_mode",
    "avoid_overlap_with", "is_valid_prompt", "notes",
]
SCENARIO_COLUMNS = [
    "scenario_id", "research_question", "system_prompt_profile", "q2_only_change_note", "use_for_frontier_q2",
    "use_for_q3_aux", "turn_count", "system_rule_set", "system_prompt_text", "target_rule_id", "target_rule_category",
    "target_rule_text", "attack_type", "attack_scope", "prompt_text", "is_valid_prompt",
]
