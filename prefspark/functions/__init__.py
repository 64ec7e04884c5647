from prefspark.functions.arrays import (eos_penalty, mean_logit, pad_left, pad_token, truncate_left,
                                        truncate_right)
from prefspark.functions.templates import (DOMAINS, generator_prompt, judge_prompt, render,
                                           render_sql)
from prefspark.functions.text import (ceil_div, fmt4, hash_hex, hash_unit32, parse_preference,
                                      path_name, reward_input, strip_label, strip_ws, take_count,
                                      word_count, words)

__all__ = [
    "DOMAINS", "ceil_div", "eos_penalty", "fmt4", "generator_prompt", "hash_hex", "hash_unit32",
    "judge_prompt", "mean_logit", "pad_left", "pad_token", "parse_preference", "path_name",
    "render", "render_sql", "reward_input", "strip_label", "strip_ws", "take_count",
    "truncate_left", "truncate_right", "word_count", "words",
]
