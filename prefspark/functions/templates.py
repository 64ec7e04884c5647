"""Prompt templates (X5 judge prompts, X6 generator prompt) and the domain list.

A template is rendered with ``concat`` of literals and columns, so the whole prompt is built
JVM-side; the same template can be rendered as DuckDB SQL for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions._util import as_col

# ---------------------------------------------------------------------------------------
# FIXED VALUES - must equal the reference's texts character for character (white space,
# indentation and the final line break included). Placeholders are {name}.
# ---------------------------------------------------------------------------------------

# Judge prompt of the sharded large-model batch judge.
JUDGE_TEMPLATE_V1 = (
    "Given the Constitution below, a prompt, and two responses, choose which response better "
    "adheres to the guidelines of the Constitution.\n"
    "\n"
    "Constitution:\n"
    "{constitution}\n"
    "\n"
    "Prompt:\n"
    "{prompt}\n"
    "\n"
    "Response 1:\n"
    "\"{response_1}\"\n"
    "\n"
    "Response 2:\n"
    "\"{response_2}\"\n"
    "\n"
    "Based on the Constitution, which response better adheres to the guidelines? Respond with "
    "\"0\" if Response 1 is better or \"1\" if Response 2 is better. Please respond with only a "
    "0 or a 1 and nothing else.\n"
)

# Judge prompt of the one-process-per-GPU batch judge.
JUDGE_TEMPLATE_V2 = (
    " Given a Constituition which starts in the next line, and a prompt and two responses that "
    "will follow, choose which response better adheres to the guidelines of the constitution.\n"
    "        Constitution:{constitution}\n"
    "\n"
    "        Prompt and Responses:\n"
    "\n"
    "        Prompt: {prompt}\n"
    "\n"
    "        Two responses:\n"
    "        Response 1: \"{response_1}\"\n"
    "        Response 2: \"{response_2}\"\n"
    "\n"
    "        Based on the constitution, which response better adheres to the guidelines? Respond "
    "with \"0\" if Response 1 is better or \"1\" if Response 2 is better. I only want to see a 0 "
    "or a 1 nothing else.\n"
    "        "
)

# Judge prompt of the notebook.
JUDGE_TEMPLATE_V3 = (
    "{constitution}\n"
    "        Given the constitution above and the following prompt:\n"
    "\n"
    "        \"{prompt}\"\n"
    "\n"
    "        Here are two responses:\n"
    "\n"
    "        Response 1: \"{response_1}\"\n"
    "\n"
    "        Response 2: \"{response_2}\"\n"
    "\n"
    "        Based on the constitution, which response better adheres to the guidelines? Respond "
    "with \"0\" if Response 1 is better or \"1\" if Response 2 is better."
)

# Generator prompt (the stray "f" before the domain and the count is dropped on purpose).
GENERATOR_TEMPLATE = (
    "{constitution}\n"
    "\n"
    "        Given the constitution listed above, create a dataset with three columns: a prompt, "
    "Response 1, and Response 2. The prompt should describe a common scenario or situation or "
    "state in the world. Response 1 should obey the list of constitutions provided, ensuring it "
    "aligns with ethical principles like equality, respect, and fairness. Response 2 should be a "
    "counterexample that doesn't follow the constitutions and violates one or more of these "
    "principles. You dont need to start your prompt by saying \"User asks\". Ensure the prompts "
    "cover a variety of everyday situations only in {domain} context. Give me {n} such examples.\n"
    "        "
)

# The ten generation contexts, in order; context_id 1 is the first.
DOMAINS = [
    "Health and Well-being",
    "Education and Learning",
    "Workplace and Employment",
    "Social Media and Online Behavior",
    "Environmental Sustainability",
    "Human Rights and Social Justice",
    "Technology and Privacy",
    "Family and Relationships",
    "Legal and Ethical Dilemmas",
    "Politics and Governance",
]

# Labels the generator puts in front of responses; removed before writing.
RESPONSE_LABELS = {"response_1": "Response 1:", "response_2": "Response 2:"}

# ---------------------------------------------------------------------------------------

JUDGE_TEMPLATES = {"v1": JUDGE_TEMPLATE_V1, "v2": JUDGE_TEMPLATE_V2, "v3": JUDGE_TEMPLATE_V3}

_PLACEHOLDER = re.compile(r"\{([a-z_0-9]+)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ('lit', text) and ('col', name) parts."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(("lit", template[pos:m.start()]))
        parts.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(template):
        parts.append(("lit", template[pos:]))
    return parts


def render(template: str, **cols) -> Column:
    """Render a template as one ``concat`` expression; values are columns or names."""
    pieces = []
    for kind, value in template_parts(template):
        if kind == "lit":
            pieces.append(F.lit(value))
        else:
            if value not in cols:
                raise KeyError(f"template needs a value for {{{value}}}")
            pieces.append(as_col(cols[value]).cast("string"))
    return F.concat(*pieces)


def render_sql(template: str, **exprs: str) -> str:
    """The same template as an ANSI SQL ``concat`` over SQL expressions (for the oracle)."""
    pieces = []
    for kind, value in template_parts(template):
        if kind == "lit":
            pieces.append("'" + value.replace("'", "''") + "'")
        else:
            pieces.append(f"CAST({exprs[value]} AS VARCHAR)")
    return "concat(" + ", ".join(pieces) + ")"


def judge_prompt(constitution, prompt, response_1, response_2, variant: str = "v1") -> Column:
    """The judge prompt for one preference pair."""
    try:
        template = JUDGE_TEMPLATES[variant.lower()]
    except KeyError:
        raise ValueError(f"unknown judge template {variant!r}; choose one of {sorted(JUDGE_TEMPLATES)}")
    return render(template, constitution=constitution, prompt=prompt,
                  response_1=response_1, response_2=response_2)


def generator_prompt(constitution, domain, n) -> Column:
    """The prompt asking a generator for ``n`` preference rows in ``domain``."""
    return render(GENERATOR_TEMPLATE, constitution=constitution, domain=domain, n=n)
