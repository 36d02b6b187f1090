"""Fixed values of the transcript rules: word lists, patterns, limits.

Patterns are written for ASCII word boundaries and Unicode white space, which ``java`` puts
into Java's terms.
"""

from __future__ import annotations

import re

# Characters.
CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af]"
BLANK = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = False) -> str:
    """``\\b`` between ASCII word characters and others only, ``\\s`` with all Unicode blanks."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _EDGE).replace(r"[^\s", "[^" + BLANK).replace(r"\s", "[" + BLANK + "]")


#: Marks a message that is itself a summary.
SENTINEL = "[session summary]"

# Limits in characters, tokens, lines and items.
FIELD_MAX, OVERSIZED_BYTES, OVERSIZED_FIELD = 32_000, 2_000_000, 8_000
GOAL_CHARS, LEADING_CHARS, GOALS_MAX = 200, 200, 8
FILES_MAX = {"Modified": 20, "Created": 20, "Read": 10}
COMMITS_MAX, PREFS_MAX, PREFS_MERGED_MAX, OUTSTANDING_MAX, OUTSTANDING_WINDOW = 8, 10, 15, 5, 60
BRIEF_USER_TOKENS, BRIEF_ASSISTANT_TOKENS, BRIEF_LINES, BRIEF_MERGED_LINES = 256, 200, 120, 300
STATE_USER_TOKENS, STATE_ASSISTANT_TOKENS, STATE_PROPOSAL_TOKENS, STATE_TOOLS, STATE_RESULTS = 600, 900, 500, 8, 3
PAGE_SIZE, SNIPPET, OUTPUT_MAX, EXPAND_TOOL_TEXT, LINES_PAGE = 8, 360, 48_000, 4_000, 40
RETRY_WAIT_S = 30
CHUNK_TOKENS, OBSERVE_AFTER, POOL_TOKENS, ITEM_TOKENS, OBSERVED_MAX = 20_000, 8_000, 6_000, 8, 20_000
KIND_SHARES = {"constraint": 0.2, "lesson": 0.3, "decision": 0.25, "state": 0.1, "fact": 0.15}
LASTING_KINDS = ["constraint", "lesson", "decision"]
RELEVANCES = ["low", "medium", "high", "critical"]

# Tools.
NOISE_TOOLS = ["TodoWrite", "TodoRead", "ToolSearch", "AskUserQuestion", "EnterPlanMode", "ExitPlanMode", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet"]
READ_TOOLS = ["Read", "NotebookRead"]
WRITE_TOOLS = ["Edit", "MultiEdit", "Write", "NotebookEdit"]
READ_ONLY_PROGRAMS = ["cat", "head", "tail", "less", "sed", "grep", "rg", "ag", "find", "fd", "ls", "tree", "wc", "sort", "uniq", "cut", "jq", "awk", "echo", "printf", "pwd", "which", "file", "stat", "diff", "cd", "true"]
#: How programs name the files that they write.
WRITING_PROGRAMS = {"cat": "redirect", "echo": "redirect", "printf": "redirect", "tee": "arguments", "sed": "in place"}

# What is left out of a shown command.
LEADING_CD = r"^\s*cd\s+\S+\s*(&&|;)\s*"
LEADING_ASSIGNMENTS = r"^(\s*[A-Za-z_][A-Za-z0-9_]*=\S*\s*(;|&&)?\s*)+"
TRAILING_PAGER = r"\s*\|\s*(head|tail|sort|wc|uniq)(?![A-Za-z0-9_])[^|]*\z"

# Patterns of cleaning.
WRAPPER_TAGS = "system-reminder|ide_opened_file|ide_selection|command-message|command-name|command-args|local-command-stdout|local-command-caveat|user-prompt-submit-hook"
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"

# Patterns of goals.
SCOPE_CHANGE = java(r"\b(instead|actually|change of plan|forget that|new task|switch to|now I want|pivot|let'?s do|stop .* and)\b|代わりに|やっぱり|方針を?変え|方針変更|ではなく|じゃなくて|切り替え|新しいタスク|今度は|次は|それより|やめて", True)
TASK = java(r"\b(fix|implement|add|create|build|refactor|debug|investigate|update|remove|delete|migrate|deploy|test|write|set up)\b|修正|実装|追加|作成|作って|作りたい|直して|リファクタ|調査|調べて|更新|削除|移行|デプロイ|テスト|書いて|設定|構築|導入|対応して|変更して", True)
NOISE_SHORT = java(r"^(ok|yes|no|sure|yeah|yep|go|hi|hey|thx|thanks|ok\b.*|y|n|k|はい|いいえ|うん|ok です|お願いします|ありがとう.*|続けて|どうぞ)\s*[.!?。！？]*\z", True)
NON_GOAL = java(r"^\s*[\[│├└─╭╰]|```|^\s*(=[A-Z]+\(|function |const |let |var |import |export |class )|^(https?:|file:|/[A-Za-z])[^\s]*\z|\\n|^\s*For each\b|\bin full\b[^\n]*\b(comments|issue|issues|PRs?|linked)\b")
TEMPLATE_SIGNAL = java(r"^\s*(For each\b|Do NOT implement\b|Analyze and propose\b|If Task/context\b|Output:\s*\z)", True)
BULLET = java(r"^\s*(?:[-*+]|[0-9]+\.)\s+")

# Patterns of standing preferences.
PREFERENCE = java(
    r"\bprefer(?:s|red|ring)?\s+[A-Za-z0-9_]"
    r"|\bdon'?t want\b"
    r"|\balways (?:use|do|run|prefer|keep|make|format|write|add|set|put|prefix|start|include|append)\b"
    r"|\bnever (?:use|do|run|push|commit|write|ignore|add|set|put|remove|delete|include|deploy)\b"
    r"|\bplease (?:use|avoid|keep|make|don'?t|do not|format|write)\b"
    r"|\b(?:style|format|language|naming)\s*[:=]\s*[^\s]"
    r"|\bstop (?:doing|using|adding|running|writing|committing|pushing)\b"
    r"|\b(?:that's|this is) wrong\b"
    r"|\b(?:revert|undo) (?:that|this|the|it|your)\b"
    r"|不要|不用|别再|回退|错了|停止|以后|下次|必须"
    r"|必ず|常に|いつも|今後|以後|次から|これから(?:は)?|絶対に?|しないで|しないように|使わないで|避けて|禁止|やめて|ではなく|じゃなくて|違います|間違って|元に戻して|好み|優先して",
    True,
)
INTERROGATIVE = java(r"^(?:what|where|when|who|whom|whose|why|how|which)\b", True) + "|为什么|怎么|如何|什么|哪里|哪个|何|なぜ|なんで|どう|どこ|どれ|どの|いつ|誰"
QUOTES_BEFORE, QUOTES_AFTER = "^[“‘\"'「『]+", "[”’\"'」』]+\\z"

# Patterns of errors and reports.
BLOCKER = java(r"\b(fail(ed|s|ure|ing)?|broken|cannot|can't|won't work|does not work|doesn't work|still (broken|failing|wrong)|blocked|blocker|not (fixed|resolved|working)|crash(es|ed|ing)?)\b", True)
BLOCKER_CJK = "失败|报错|卡住|崩溃|失敗|エラーが|動かない|動きません|落ちる|落ちます|通らない|直らない|うまくいかない|未解決|ブロック"
BENIGN_CJK = "错误(?:处理|信息|消息|码)|失败(?:重试|率)|エラー(?:処理|ハンドリング|メッセージ)"
SENTENCE_START = java(r"^\s*[\"'`*_【『「]?[A-Z`\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
LIST_START = java(r"^\s*[-*+>(]")
DECLINED = "(?i)user (doesn't|does not) want to proceed|rejected by the user|denied by the user|user declined"
ERROR_LINE = "(?i)error|fail|panic|exception|✘|denied|not found|cannot|can't|no such"
ZERO_COUNT = java(r"\b(?:0|no|zero) (?:failed|failures?|errors?|warnings?)\b", True)
EXIT_CODE = java(r"^\s*Exit code [0-9]+\s*\n")
PATH_TOKEN = java(r"[A-Za-z0-9_.$/-]*[A-Za-z0-9_-]+\.[A-Za-z0-9]{1,5}\b")

# Patterns of commits, files, notifications.
GIT_COMMIT = java(r"\bgit\s+commit\b")
COMMIT_MESSAGES = [java(p) for p in (
    r"git\s+commit\b[^\n]*?\s-[a-zA-Z]*m\s+\"([^\"]+)\"",
    r"git\s+commit\b[^\n]*?\s-[a-zA-Z]*m\s+'([^']+)'",
    r"git\s+commit\b[^\n]*?<<-?\s*['\"]?[A-Za-z0-9_]+['\"]?\)?\s*\n\s*([^\n]+)",
)]
COMMIT_HASH = r"\[[^\]\s]+(?: \(root-commit\))? ([0-9a-f]{7,12})\]"
TASK_OUTPUT = r"/tasks/[^/]+\.output\z"
#: Folders of a user's home whose files are the host's own, not the work's.
HOST_FOLDERS = [".claude"]
HARNESS_PATH = rf"^/(?:Users|home)/[^/]+/(?:{'|'.join(map(re.escape, HOST_FOLDERS))})/"
NOTIFICATION = java(r"^\s*<task-notification>")
SKILL_BLOCK = r"<skill[^>]*name=\"([^\"]+)\"[\s\S]*?</skill>"

# Patterns of shell commands.
HEREDOC = re.compile(r"<<-?\s*(['\"]?)(\w+)\1")
ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")
#: A mark that sends output, but not that of errors, and a file that may be joined to it.
REDIRECT = re.compile(r"[013-9]?(?:>>?|&>)(?P<file>.*)", re.S)
#: Neither another stream nor the null device.
OUTPUT_FILE = re.compile(r"(?!&|/dev/null\Z).*", re.S)
IN_PLACE = re.compile(r"-[a-zA-Z]*i")
SUBCOMMAND = re.compile(r"[a-z][\w:-]*", re.A)
WRITES_IN_CODE = re.compile(r"\.write_text\(|\bopen\([^)]*['\"][wa]['\"]")
PATH_IN_CODE = re.compile(r"\b(?:Path|open)\(\s*(['\"])([^'\"]+)\1")
#: A path that stands for itself and is of the work: with a slash or a dot, without marks that a shell expands, no option and not the host's.
PLAIN_PATH = re.compile(rf"(?!-|/dev/null\Z|{HARNESS_PATH})(?=[^/.]*[/.])[^$*?{{}}()<>`|\\]{{2,}}")
