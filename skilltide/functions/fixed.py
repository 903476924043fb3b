"""Fixed values. Results depend on these exact strings and numbers."""

# The six quality categories a repository is graded in.
GRADE_CATEGORIES = ["Maintainable", "Testable", "Robust", "Secure", "Automated", "Performant"]

# Contact categories.
CONTACT_CATEGORIES = ["Email", "Website"]

# Keys every tokenised query carries, present even when empty.
TOKEN_TYPES = ["language", "technology", "city", "country", "stopWord", "githubLogin"]

# Message kinds of the analyzer message table.
WARNING = "warning"
DEPENDENCE = "dependence"
LINES_OF_CODE = "lines_of_code"
AUTOMATION_TOOL = "automation_tool"
TESTS_DIR_EXISTS = "tests_dir_exists"
ALL_LANGUAGES = "all_languages"

# Automation tools recognised by file name.
AUTOMATION_FILES = {
    "ansible.cfg": "ansible",
    "appveyor.yml": "appveyor",
    "circle.yml": "circleci",
    ".codeclimate.yml": "codeclimate",
    "Dockerfile": "docker",
    ".travis.yml": "travis",
}

# Automation tools recognised by a badge address in a Markdown file.
AUTOMATION_BADGES = {
    "https://semaphoreci.com/api/": "semaphoreci",
    "https://app.codeship.com/": "codeship",
    "http://codecov.io/": "codecov",
    "https://codecov.io/": "codecov",
    "https://www.bithound.io/": "bithound",
    "https://www.versioneye.com/": "versioneye",
    "https://david-dm.org/": "david-dm",
    "https://dependencyci.com/": "dependencyci",
    "https://snyk.io/": "snyk",
}

# Standard headers that reveal a library: (language, library, headers).
HEADER_LIBRARIES = [
    ("C", "libc",
     "assert.h complex.h ctype.h errno.h fenv.h float.h inttypes.h iso646.h limits.h locale.h "
     "math.h setjmp.h signal.h stdalign.h stdarg.h stdatomic.h stdbool.h stddef.h stdint.h "
     "stdio.h stdlib.h stdnoreturn.h string.h tgmath.h threads.h time.h uchar.h wchar.h wctype.h"),
    ("C++", "STL",
     "algorithm array vector deque list forward_list set map unordered_set unordered_map "
     "stack queue"),
    ("C++", "Qt", "QApplication QCoreApplication QObject QWidget"),
]

# Header path prefixes that reveal a library: (language, prefix, library).
HEADER_PREFIXES = [("C++", "boost/", "Boost"), ("C++", "QtCore/", "Qt")]

# Which analyzer handles a repository language.
LANGUAGE_ANALYZERS = [("JavaScript", "javascript"), ("C", "cpp"), ("C++", "cpp")]

# Patterns.
OWNER_ID_PATTERN = r"^(\d*?):(.*?)(\d*)$"
VALID_PATH_PATTERN = r"^[a-zA-Z0-9/._-]*$"
INVALID_EXTENSION_PATTERN = r"(?i)\.(exe|obj|o|so|dll)$"
TESTS_DIR_PATTERN = r"/[Tt]ests?/"
INCLUDE_PATTERN = r"#include[^\S\r\n]*<([a-zA-Z0-9/._-]*)>[^\r\n]*"
# Comments of C, C++ and JavaScript; group 1 is what looks like one and stays: escapes and literals.
# Possessive, so that a long text neither backtracks nor recurses.
COMMENT_PATTERN = (
    r"""(\\[\s\S]|"[^"\\\r\n]*+(?:\\[\s\S][^"\\\r\n]*+)*+"|'[^'\\\r\n]*+(?:\\[\s\S][^'\\\r\n]*+)*+'"""
    r"""|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)|//[^\r\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)""")
NODE_SHEBANG_PATTERN = r"(?m)^#!/usr/bin/(env |)node"
MANIFEST_PATTERN = r"(^|/)(package|bower)\.json$"
NOISE_FILE_PATTERN = r"(^|/)(\.eslint[^/]*|yarn\.lock|[^/]*\.min\.js|package-lock\.json|\.gitignore)$"
BINARY_FILE_PATTERN = r"(?i)\.(so|exe|o)$"
VENDOR_DIR_PATTERN = r"(^|/)node_modules/"
LEXEME_DELIMITER = r"[\s/\\]+"
LEXEME_PATTERN = r"^([.,;'\"]*)(.+?)([.,;'\"]*)$"

# A tool file must be larger than this many bytes.
MIN_TOOL_FILE_BYTES = 10
# Automation tools needed for a full Automated grade.
FULL_AUTOMATION_TOOLS = 3

# Synonym rules: languages with a package manager, shortest stem, delimiters.
PACKAGE_MANAGER_LANGUAGES = ["JavaScript"]
MIN_STEM_LENGTH = 4
SYNONYM_DELIMITERS = "-_."

# Limits of the search page.
SEARCH_PAGE_SIZE = 20
MAX_SUGGESTIONS = 10

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don "
    "should now"
).split()
