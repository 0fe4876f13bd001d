"""Word lists, constants and labels that must hold exact values.

Fixed values: changing one changes results.
"""

# Markers of the two-hit language test (B12 "distinct").
FRENCH_MARKERS = """qui est que quoi comment pourquoi quand quel quelle quels quelles sont avec
dans pour sur entre comme mais donc aussi tous tout cette ces leur leurs nous vous ils elles ont
était être avoir fait très plus moins bien peut doit faut parce depuis pendant avant après contre
sans sous vers chez trouve montre cherche emails mails connexions liens""".split()

SPANISH_MARKERS = """que quien como donde cuando porque cual cuales es son con para por entre
sobre pero todos esta estas estos ellos ellas""".split()

# Markers of the space-delimited language test (B12 "presence").
FRENCH_PRESENCE = "le la les de du des un une et est sont avec pour dans sur ce cette ces".split()
ENGLISH_PRESENCE = "the is are and or but for with this that have has".split()

# Keyword stop words.
KEYWORD_STOP = """the a an is are was were be been being have has had do does did will would could
should may might must shall can need dare ought used to of in for on with at by from as into
through during before after above below between under again further then once and but or nor so
yet both either neither not only own same than too very just also now here there when where why
how all each every few more most other some such no any this that these those i you he she it we
they me him her us them""".split()

# Query stop words.
QUERY_STOP = """the a an is are was were be been being have has had do does did will would could
should may might must shall can need dare ought used to of in for on with at by from as into
through during before after above who what where when why how which show me find get tell give
list all any some every qui que quoi est sont était étaient être avoir fait avec dans pour sur par
entre comme mais donc aussi tous tout cette ces leur leurs nous vous ils elles ont très plus moins
bien peut doit faut quand comment pourquoi quel quelle quels""".split()

# Question openers dropped from a conversation title (B16), tried in this order.
TITLE_STARTERS = ["who is ", "what is ", "what are ", "who are ", "tell me about ", "can you ",
                  "could you ", "please ", "i want to know ", "qui est ", "qu'est-ce que ",
                  "c'est quoi "]

GREETINGS = "salut bonjour hello hi hey coucou bonsoir yo wesh slt".split()

HIGH_PRIORITY = ["fraud", "criminal", "urgent", "breaking", "money laundering"]

SUBJECT_SKIP = """who what where when how is are was were the a an of to in qui quoi est sont le
la""".split()

# Month names in the order they are tried.
MONTHS = [("january", "01"), ("february", "02"), ("march", "03"), ("april", "04"), ("may", "05"),
          ("june", "06"), ("july", "07"), ("august", "08"), ("september", "09"), ("october", "10"),
          ("november", "11"), ("december", "12"), ("jan", "01"), ("feb", "02"), ("mar", "03"),
          ("apr", "04"), ("jun", "06"), ("jul", "07"), ("aug", "08"), ("sep", "09"),
          ("oct", "10"), ("nov", "11"), ("dec", "12")]

GENERIC_MAIL_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]

# Words that never count towards shared vocabulary of two claims.
CLAIM_STOP = "the a an is are was were that this of in to and".split()

# Local parts that stand for a role and not for a person.
ROLE_LOCALS = ["info", "admin", "support", "contact", "noreply"]

# Field of a category by its prefix.
CATEGORY_FIELDS = {"math": "Mathematics", "physics": "Physics", "cs": "Computer Science", "q-bio": "Biology", "q-fin": "Finance", "stat": "Statistics", "econ": "Economics"}
