"""Fixed values.

Everything in this module is a value that has to be identical to what the
original tool uses (file extensions, verdict labels, default cleaning
lists, stop strings, prompt texts, model registry). They are written out in
their natural order; nothing here is logic.
"""

from __future__ import annotations

# --- FIXED VALUES: languages and file extensions -------------------------
LANGUAGES = ["C", "C++", "Java", "Python", "Go"]
EXTENSIONS = {"C": ".c", "C++": ".cpp", "Java": ".java", "Python": ".py", "Go": ".go"}
DATASETS = ["codenet", "avatar"]

# --- FIXED VALUES: verdicts (code -> label; 5 is "unknown" -> NULL) -------
SUCCESS = "success"
RUNTIME_FAILED = "runtime_failed"
COMPILE_FAILED = "compile_failed"
INFINITE_LOOP = "infinite_loop"
TEST_FAILED = "test_failed"
VERDICT_CODES = {
    0: SUCCESS,
    1: RUNTIME_FAILED,
    2: COMPILE_FAILED,
    3: INFINITE_LOOP,
    4: TEST_FAILED,
    5: None,
}

# --- FIXED VALUES: limits --------------------------------------------------
TEST_TIMEOUT_S = 100.0       # per test run
SAMPLE_BUDGET_S = 100.0      # whole sample (watchdog)
STOP_CAP_CHARS = 10000       # generation output is always cut to this many chars
DEFAULT_KS = (1, 5)          # pass@k values reported
SEED_SAMPLE_SIZE = 5         # seeds per test-generation round
TESTGEN_ROUNDS = 20          # iterations counter starts here and runs down to 0

# --- FIXED VALUES: default sanitizer lists (order matters) ---------------
DEFAULT_EOFS = [
    "# <END-OF-CODE>", "// <END-OF-CODE>", "<END-OF-CODE>", "END-OF-CODE",
    "Python:", "Java:", "C:", "C++:", "Go:", "# Answer:",
    "# 2nd solution:", "Note", "Input:", "1.", "Explanation", "A:",
]
DEFAULT_PREFIXES = [
    "Translate the above", '"""', "Here", "[PYTHON]", "[JAVA]", "[C]", "[C++]", "[GO]",
    "C++", "cpp", "c++", "C", "Python", "python", "Java", "java", "Go", "go",
    "The", "Please", "This", "That", "After", "You", "-", "In", "Also", "To", "Key",
]

# --- FIXED VALUES: sanitizer rule triggers (substring of the output path) --
# rule name -> path substrings that switch it on, in the order rules run
SANITIZE_TRIGGERS = [
    ("strip_marker", ["code-llama"]),
    ("magicoder", ["magicoder"]),
    ("octocoder", ["octocoder"]),
    ("mixtral", ["mixtral"]),
    ("phi2", ["phi2"]),
    ("gpt_fence", ["gpt-4", "gpt-3.5"]),
    ("gemini", ["gemini-pro"]),
    ("claude", ["claude"]),
    ("deepseek_fence", ["deepseek"]),
]
SANITIZED_SUFFIX = "-sanitized"

# --- FIXED VALUES: failed-generation sentinels ----------------------------
GEMINI_ERROR = "GEMINI API ERROR"
MAX_LENGTH_EXCEEDED = "MODEL MAX LENGTH EXCEEDED"

# --- FIXED VALUES: stop strings per decoder family -------------------------
BASE_STOPS = ["<|endoftext|>", "<|endofmask|>", "</s>"]
CHATML_EXTRA_STOPS = ["\n```"]
INCODER_EXTRA_STOPS = ["<|endofmask|>", "<|/ file", "</cell>", "</text>", "</code>", "<|", "</CODE>"]
CODEGEN2_EXTRA_STOPS = ["<eom>"]
SANTACODER_EXTRA_STOPS = ["<|endofmask|>"]
ANTHROPIC_STOP = "\n```\n"

# --- FIXED VALUES: fill-in-the-middle wrappers (prefix, suffix) -----------
FIM_WRAPPERS = {
    "incoder": ("", "<|mask:0|><|mask:1|><|mask:0|>"),
    "codegen2": ("", "<mask_1><|endoftext|><sep><mask_1>"),
    "santacoder": ("<fim-prefix>", "<fim-suffix>\n<fim-middle>"),
    "starcoder_infill": ("<fim_prefix>", "<fim_suffix><fim_middle>"),
}

# --- FIXED VALUES: chat system texts ---------------------------------------
TRANSLATOR_SYSTEM = "You are a code translation expert."
ASSISTANT_SYSTEM_TEXT = "You are a helpful assistant good at coding."
ASSISTANT_SYSTEM_JSON = "You are a helpful assistant designed to output JSON."

# --- FIXED VALUES: test-generation instructions ---------------------------
TESTGEN_INSTRUCTIONS = [
    "Please generate complex inputs to test the function.",
    "Please generate corner case inputs to test the function.",
    "Please generate difficult inputs to test the function.",
]
TESTGEN_HEADER = "Here is a function that we want to test:\n```\n"
TESTGEN_EXAMPLES = "\nThese are some example inputs used to test the function:\n```\n"

# --- FIXED VALUES: prompt templates ----------------------------------------
# Placeholders: {src} source language, {trg} target language, {code} source code.
# The indentation inside the multi-line texts is part of the prompt.
PROMPT_TEMPLATES = {
    "base": """{src}:
{code}

Translate the above {src} code to {trg} and end with comment "<END-OF-CODE>".

{trg}:
""",
    "gpt": """You are a code translation expert. Translate the {src} code below to {trg}

{src}
{code}

{trg}
""",
    "gemini": """You are a code translation expert. Translate the {src} code below to {trg}

{src}
{code}

{trg}
""",
    "claude": """
```Translate the {src} code below to {trg}

{src}
{code}

{trg}
```
""",
    "codellama": """<s>[INST] <<SYS>> You are a code translation expert. <</SYS>>

Translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"

[/INST]

{src}:
{code}

{trg}:
""",
    "octocoder": """Question: You are a code translation expert. Translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"

{src}
{code}

Answer:
 {trg}
""",
    "dolphin": """<|im_start|>system
                You are a code translation expert.<|im_end|>
                <|im_start|>user
                Can you translate the following {src} code into {trg} and end with comment "<END-OF-CODE>"?
                ```{src}
                {code}
                ```
                <|im_end|>
                <|im_start|>assistant
                ```{trg}
                """,
    "starcoder": """<fim_prefix>{src}:
{code}
{trg}:
<fim_suffix><fim_middle>""",
    "solar": """<s> ### User:
        Can you translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"?
        ```{src}
        {code}
        ```

        ### Assistant:
        Sure!
        ```{trg}
        """,
    "wizardcoder": """You are a code translation expert. Below is an instruction that describes a code translation task. Write a response that appropriately completes the request.

        ### Instruction:
        Write {trg} code that translates the following {src} code and end with comment"<END-OF-CODE>":
        {code}

        ### Response:""",
    "deepseek": """You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.
        ### Instruction:
        Translate the following {src} code to {trg}.

{src}
{code}

        ### Response:
        """,
    "phi": """Instruct: You are a code translation expert. Translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"

{src}
{code}

Output:
 {trg}
""",
    "magic": """You are an exceptionally intelligent coding assistant that consistently delivers accurate and reliable responses to user instructions.

        @@ Instruction
        You are a code translation expert. Translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"

{src}
{code}
'

        @@ Response
        {trg}
        """,
    "vicuna": """### System Prompt
                     You are a code translation expert.

                    ### User Message
                    Translate the {src} code below to {trg} and end with comment "<END-OF-CODE>"

{src}
{code}


                    ### Assistant
                   """,
    "mistral-hermes": """<|im_start|>system
                You are a code translation expert.<|im_end|>
                <|im_start|>user
                Can you translate the following {src} code into {trg} and end with comment "<END-OF-CODE>"?
                ```{src}
                {code}
                ```
                <|im_end|>
                <|im_start|>assistant
                ```{trg}
                """,
}
# prompt types the command line offers
CLI_PROMPT_TYPES = ["base", "gemini", "claude", "gpt", "codellama", "octocoder", "dolphin", "solar",
                    "wizardcoder", "deepseek"]

# --- FIXED VALUES: model registry -------------------------------------------
# (match kind, pattern, decoder family, hub name or None when built from the alias, conversational)
# Rules are tried in this order; the first match wins; no match is an error.
REGISTRY_RULES = [
    ("exact", "codegen-2b", "hf", "Salesforce/codegen-2B-mono", False),
    ("exact", "codegen-6b", "hf", "Salesforce/codegen-6B-mono", False),
    ("exact", "codegen-16b", "hf", "Salesforce/codegen-16B-mono", False),
    ("exact", "codegen2-1b", "codegen2", "Salesforce/codegen2-1B", False),
    ("exact", "codegen2-3b", "codegen2", "Salesforce/codegen2-3_7B", False),
    ("exact", "codegen2-7b", "codegen2", "Salesforce/codegen2-7B", False),
    ("exact", "codegen2-16b", "codegen2", "Salesforce/codegen2-16B", False),
    ("exact", "polycoder", "hf", "NinedayWang/PolyCoder-2.7B", False),
    ("exact", "santacoder", "santacoder", "bigcode/santacoder", False),
    ("exact", "incoder-1b", "incoder", "facebook/incoder-1B", False),
    ("exact", "incoder-6b", "incoder", "facebook/incoder-6B", False),
    ("exact", "stablelm-7b", "hf", "StabilityAI/stablelm-base-alpha-7b", False),
    ("prefix", "gpt-3.5-", "openai", None, True),
    ("prefix", "gpt-4", "openai", None, True),
    ("prefix", "claude", "anthropic", None, False),
    ("prefix", "gemini", "gemini", None, False),
    ("exact", "gptneo-2b", "hf", "EleutherAI/gpt-neo-2.7B", False),
    ("exact", "gpt-j", "hf", "EleutherAI/gpt-j-6B", False),
    ("prefix", "starcoder", "vllm", "bigcode/{alias}", False),
    ("exact", "codet5p-2b", "codet5p", "Salesforce/codet5p-2b", False),
    ("exact", "codet5p-6b", "codet5p", "Salesforce/codet5p-6b", False),
    ("exact", "codet5p-16b", "codet5p", "Salesforce/codet5p-16b", False),
    ("prefix", "code-llama-", "vllm", "codellama/CodeLlama-{last}-Instruct-hf", False),
    ("prefix", "deepseek-coder", "deepseek", "deepseek-ai/deepseek-coder-{size}b-{variant}", None),
    ("exact", "wizardcoder-33b", "vllm", "WizardLM/WizardCoder-33B-V1.1", True),
    ("exact", "wizardcoder-34b", "vllm", "WizardLM/WizardCoder-Python-34B-V1.0", True),
    ("exact", "wizardcoder-15b", "vllm", "WizardLM/WizardCoder-15B-V1.0", True),
    ("exact", "wizardcoder-7b", "vllm", "WizardLM/WizardCoder-Python-7B-V1.0", True),
    ("exact", "mistral-7b-codealpaca", "hf", "Nondzu/Mistral-7B-codealpaca-lora", False),
    ("exact", "zephyr-7b", "hf", "HuggingFaceH4/zephyr-7b-beta", False),
    ("exact", "codebooga-34b", "hf", "oobabooga/CodeBooga-34B-v0.1", False),
    ("exact", "phind-code-llama-34b-v2", "vllm", "Phind/Phind-CodeLlama-34B-v2", False),
    ("exact", "mistral-7b", "hf", "mistralai/Mistral-7B-v0.1", False),
    ("exact", "dolphin-2.6", "chatml", "cognitivecomputations/dolphin-2.6-mixtral-8x7b", True),
    ("exact", "solar-10.7b-instruct", "chatml", "upstage/SOLAR-10.7B-Instruct-v1.0", True),
    ("exact", "mistral-hermes-codepro-7b", "chatml", "beowolx/MistralHermes-CodePro-7B-v1", True),
    ("exact", "phi-2", "vllm", "microsoft/phi-2", False),
    ("exact", "mixtral-8x7b-instruct", "vllm", "mistralai/Mixtral-8x7B-Instruct-v0.1", False),
    ("exact", "octocoder", "vllm", "bigcode/octocoder", False),
    ("exact", "magicoder-s-ds-6.7b", "vllm", "ise-uiuc/Magicoder-S-DS-6.7B", False),
    ("exact", "magicoder-s-cl-7b", "vllm", "ise-uiuc/Magicoder-S-CL-7B", False),
]
DEEPSEEK_SIZE_PATTERN = r"deepseek-coder-(\d+\.?\d*)b(.*)"

# --- FIXED VALUES: decoder family properties ----------------------------------
# family -> (extra stop strings, budget rule, context threshold, FIM wrapper or None)
# budget rule: "ctx" = min(max_len, ctx); "left" = min(max_len, ctx - prompt);
#              "left90" = min(max_len, int((ctx - prompt) * 0.9))
FAMILIES = {
    "hf": ([], "left", 1000000, None),
    "vllm": ([], "ctx", 30000, None),
    "chatml": (CHATML_EXTRA_STOPS, "ctx", 30000, None),
    "deepseek_instruct": ([], "left", 1000000, None),
    "codet5p": ([], "left", 1000000, None),
    "incoder": (INCODER_EXTRA_STOPS, "left", 1000000, "incoder"),
    "codegen2": (CODEGEN2_EXTRA_STOPS, "left", 1000000, "codegen2"),
    "santacoder": (SANTACODER_EXTRA_STOPS, "left90", 1000000, "santacoder"),
    "starcoder_infill": ([], "left90", 1000000, "starcoder_infill"),
    "openai": ([], None, None, None),
    "anthropic": ([], None, None, None),
    "gemini": ([], None, None, None),
}
DEFAULT_CONTEXT = 1024
