"""Column expressions over prompts, answers and suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import text as tx

# Message templates.
COMPLETION_SYSTEM = "You are a code completion AI. Only return code completions, no explanations."
HELP_SYSTEM = """You are {name}, an expert programming assistant. Help users with:
- Code completion and suggestions
- Debugging and error fixing
- Code explanation and documentation
- Best practices and optimization
- Architecture and design patterns

Be concise, practical, and provide code examples when helpful."""

# Words that tell what a chat message asks for, in order of precedence.
INTENT_WORDS = {
    "fix": ["error", "bug", "fix", "wrong"],
    "explain": ["explain", "what", "how", "why"],
    "optimize": ["optimize", "improve", "better", "performance"],
    "refactor": ["refactor", "clean", "structure"],
}

# What the last line is about, in order of precedence.
LINE_WORDS = {
    "function": ["def ", "function "],
    "class": ["class "],
    "import": ["import ", "from "],
    "output": ["print", "console.log"],
}

# First confidence and its step per rank, by kind of model.
CONFIDENCE_STEPS = {"custom": (0.9, -0.1), "remote": (0.85, 0.05), "local": (0.80, -0.1), "hub": (0.75, -0.1)}

# Languages that get completions, and their comment marks.
SUPPORTED = ["python", "javascript", "typescript", "java", "cpp", "c", "go", "rust", "php", "ruby"]
HASH_COMMENTS = ["python", "php", "ruby"]
SLASH_COMMENTS = ["javascript", "typescript", "java", "cpp", "c", "go", "rust", "php"]

# Fences round a suggestion.
FENCE = "```"
FENCE_TAGS = ["python", "javascript", "typescript"]

# First tip whose pattern the lower-cased message holds, by language.
ERROR_TIPS = {
    "python": {
        "indentationerror": "Check your indentation - Python requires consistent spaces or tabs.",
        "syntaxerror": "Look for missing colons, parentheses, or quotes.",
        "nameerror": "Make sure the variable is defined before using it.",
        "importerror": "Check if the module is installed: `pip install module_name`",
        "typeerror": "Check if you're calling the right method on the right object type.",
    },
    "javascript": {
        "referenceerror": "Variable is not defined. Declare it with let, const, or var.",
        "syntaxerror": "Check for missing semicolons, brackets, or quotes.",
        "typeerror": "Check if the object/function exists before calling it.",
        "cannot read property": "Object might be null or undefined. Use optional chaining (?.)",
    },
    "typescript": {
        "cannot find name": "Import the module or check the variable name.",
        "type": "Check if the types match what the function expects.",
        "property does not exist": "Add the property to the interface or use type assertion.",
    },
}

# Severity labels by number.
SEVERITIES = ["❌ Error", "⚠️ Warning", "ℹ️ Info", "💡 Hint"]


def _filled(text: Column) -> Column:
    """True unless the text is missing or empty."""
    return F.coalesce(text, F.lit("")) != ""


def chat_prompt(message: Column, context: Column) -> Column:
    """Plain prompt of one turn, with the code context in a fence if there is any."""
    code = F.concat(F.lit("Code Context:\n```\n"), context, F.lit("\n```\n"))
    return F.concat(F.lit("User: "), message, F.lit("\n"), F.when(_filled(context), code).otherwise(""), F.lit("Assistant:"))


def local_chat_prompt(message: Column, context: Column) -> Column:
    prompt = F.concat(F.lit("You are a helpful programming assistant.\n\nUser: "), message, F.lit("\nAssistant:"))
    return F.when(_filled(context), F.concat(F.lit("Code context:\n"), context, F.lit("\n\n"), prompt)).otherwise(prompt)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(message: Column, context: Column, name: str = "a code helper") -> Column:
    """Role and content list: system, code context if any, user."""
    system = _message("system", F.lit(HELP_SYSTEM.format(name=name)))
    code = _message("system", F.concat(F.lit("Code context:\n```\n"), context, F.lit("\n```")))
    user = _message("user", message)
    return F.when(_filled(context), F.array(system, code, user)).otherwise(F.array(system, user))


def completion_prompt(code: Column, language: Column, n: Column) -> Column:
    return F.concat(
        F.lit("You are an expert "), language, F.lit(" programmer. Complete the following code with "), n.cast("string"),
        F.lit(" different suggestions.\nOnly return the completion code without explanations.\n\nCode to complete:\n```"),
        language, F.lit("\n"), code, F.lit("\n```\n\nComplete this code with the most likely continuation:"),
    )


def completion_messages(code: Column, language: Column, n: Column) -> Column:
    return F.array(_message("system", F.lit(COMPLETION_SYSTEM)), _message("user", completion_prompt(code, language, n)))


def local_completion_prompt(code: Column, language: Column) -> Column:
    return F.concat(F.lit("Complete this "), language, F.lit(" code:\n"), code)


def hub_completion_prompt(code: Column, language: Column) -> Column:
    return F.concat(F.lit("# "), language, F.lit(" code completion\n"), code)


def explain_message(code: Column, language: Column) -> Column:
    return F.concat(
        F.lit("Please explain this "), language, F.lit(" code:\n\n```"), language, F.lit("\n"), code, F.lit("\n```")
    )


def fix_message(code: Column, error: Column, language: Column) -> Column:
    return F.concat(
        F.lit("I'm getting this error: \""), error, F.lit('"\n\nIn this '), language, F.lit(" code:\n\n```"), language,
        F.lit("\n"), code, F.lit("\n```\n\nCan you help me fix it?"),
    )


def explain_error_message(code: Column, error: Column, language: Column) -> Column:
    return F.concat(F.lit("Can you explain this "), language, F.lit(' error: "'), error, F.lit('"\n\nCode: '), code)


def strip_prompt(output: Column, prompt: Column) -> Column:
    """What a model wrote after the prompt."""
    return tx.strip(F.substring(output, F.length(prompt) + 1, F.length(output)))


def clean_fenced(answer: Column, language: Column) -> Column:
    """Text in the first fence without its language word; else the trimmed answer."""
    inner = tx.strip(F.get(F.split(tx.strip(answer), FENCE, -1), F.lit(1)))
    untagged = tx.let(
        inner,
        lambda t: F.when(
            F.startswith(t, language), tx.strip(F.substring(t, F.length(language) + 1, F.length(t)))
        ).otherwise(t),
    )
    return F.when(answer.contains(FENCE), untagged).otherwise(tx.strip(answer))


def clean_suggestion(suggestion: Column, strict_compat: bool = False) -> Column:
    """Trimmed suggestion without an opening and a closing fence.

    The known client tests the bare fence first, so its language tags hardly
    ever match and stay in the text; ``strict_compat`` keeps that.
    """
    def without(text: Column, mark: str, at_end: bool = False) -> Column:
        rest = F.left(text, F.length(text) - len(mark)) if at_end else F.substring(text, F.lit(len(mark) + 1), F.length(text))
        found = F.endswith(text, F.lit(mark)) if at_end else F.startswith(text, F.lit(mark))
        return F.when(found, tx.strip(rest, tx.BLANK_JS)).otherwise(text)

    def opened(text: Column) -> Column:
        tagged = [FENCE + tag for tag in FENCE_TAGS]
        if not strict_compat:
            bare = without(text, FENCE)
            for mark in tagged:
                bare = F.when(F.startswith(text, F.lit(mark)), without(text, mark)).otherwise(bare)
            return bare
        return reduce(lambda t, mark: tx.let(t, lambda bound: without(bound, mark)), [FENCE, *tagged], text)

    cleaned = tx.let(tx.strip(suggestion, tx.BLANK_JS), opened)
    return tx.let(cleaned, lambda text: without(text, FENCE, at_end=True))


def rank_confidence(rank: Column, kind: str) -> Column:
    """Confidence of the suggestion at a 0-based rank."""
    first, step = CONFIDENCE_STEPS[kind]
    return F.lit(first) + rank * F.lit(step)


def pad_suggestions(suggestions: Column, n: int) -> Column:
    """Exactly ``n`` suggestions, with empty ones at the end if need be."""
    return F.slice(F.concat(suggestions, F.array_repeat(F.lit(""), n)), 1, n)


def first_distinct(suggestions: Column, n: int) -> Column:
    return F.slice(F.array_distinct(suggestions), 1, n)


def last_line(code: Column) -> Column:
    return F.substring_index(code, "\n", -1)


def _first_class(text: Column, classes: dict[str, list[str]]) -> Column:
    found = F.lit("other")
    for name, words in reversed(classes.items()):
        found = F.when(tx.contains_any(text, words), name).otherwise(found)
    return found


def line_context(code: Column) -> Column:
    """What the last line of the code is about."""
    return _first_class(last_line(code), LINE_WORDS)


def chat_intent(message: Column) -> Column:
    return _first_class(F.lower(message), INTENT_WORDS)


def cursor_context(text: Column, line: Column, around: int = 50) -> Column:
    """The cursor's line with up to ``around`` lines on either side."""

    def window(parts: Column) -> Column:
        start = F.greatest(F.lit(0), line - around)
        end = F.least(F.size(parts) - 1, line + around)
        return tx.join_lines(parts, start.cast("int"), (end - start + 1).cast("int"))

    return tx.let(tx.lines(text), window)


def in_comment(prefix: Column, language: Column) -> Column:
    slashes = prefix.contains("//") | prefix.rlike(r"/\*[\s\S]*?\*/")
    hashes = prefix.contains("#")
    return (language.isin(HASH_COMMENTS) & hashes) | (language.isin(SLASH_COMMENTS) & slashes)


def in_string(prefix: Column) -> Column:
    """An odd number of any quote mark."""
    def odd(mark: str) -> Column:
        return (F.length(prefix) - F.length(F.replace(prefix, F.lit(mark), F.lit("")))) % 2 == 1

    return odd("'") | odd('"') | odd("`")


def should_trigger(line_text: Column, line: Column, column: Column, language: Column) -> Column:
    """Whether a cursor position asks for completions."""
    prefix = F.substring(line_text, F.lit(1), column)
    return (
        language.isin(SUPPORTED)
        & ~((line == 0) & (column < 2))
        & ~in_comment(prefix, language)
        & ~in_string(prefix)
        & (F.length(tx.strip(prefix, tx.BLANK_JS)) >= 2)
    )


def severity_label(severity: Column) -> Column:
    label = F.lit("Unknown")
    for number, name in enumerate(SEVERITIES):
        label = F.when(severity == number, name).otherwise(label)
    return label


def percent_title(confidence: Column, label: str = "Suggestion") -> Column:
    """Display title such as ``Suggestion (85%)``."""
    percent = F.floor(confidence * 100 + 0.5).cast("int").cast("string")
    return F.concat(F.lit(f"{label} ("), percent, F.lit("%)"))


def error_tip(message: Column, language: Column) -> Column:
    """First matching tip in list order, or NULL."""
    lowered = F.lower(message)
    tip = F.lit(None).cast("string")
    for name, patterns in ERROR_TIPS.items():
        matches = F.coalesce(*[F.when(lowered.contains(p), t) for p, t in patterns.items()])
        tip = F.when(language == name, matches).otherwise(tip)
    return tip
