"""Rows for rules on legal texts, derived from the given tables: each row of a table takes one of a few patterns by its key.

The tables have no courts, votes or answers. A key divided by the number of a family's patterns gives a group, the
remainder the pattern; the group's number goes into ids, case numbers and texts (in place of #), so every group is
cases, votes or answers of its own and the work grows with the table. SQL reads the same relation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Derived:
    """Patterns as SQL text over a table: ``frame`` gives the rows to Spark, ``sql`` is the same relation for other engines.

    ``ids``: columns of whole numbers that a group shifts by a thousand; in ``texts`` # becomes the group's number.
    """

    def __init__(self, columns: str, rows: str, base: str, key: str, size: int, ids: str = "", texts: str = ""):
        names, ids, texts = ([x for x in c.replace(" ", "").split(",") if x] for c in (columns, ids, texts))
        found = re.findall(r"\((?:[^()']|'[^']*')*\)", rows)
        self.rows = ", ".join(f"({i}, {row[1:]}" for i, row in enumerate(found))
        group = f"CAST(floor({key} / {size}) AS BIGINT)"
        told = [f"CAST(p.{c} + 1000 * {group} AS BIGINT) AS {c}" if c in ids else f"replace(p.{c}, '#', CAST({group} AS VARCHAR(20))) AS {c}" if c in texts else f"p.{c}" for c in names]
        self.base, self.names, self.texts = base, names, texts
        self._sql = f"(SELECT {', '.join(told)} FROM {{base}} JOIN (SELECT * FROM {{values}} AS v(i, {', '.join(names)})) p ON {key} % {size} = p.i)"
        self.sql = self._filled(base, f"(VALUES {self.rows})")

    def _filled(self, base: str, values: str) -> str:
        return self._sql.replace("{base}", base).replace("{values}", values)

    def frame(self, spark: SparkSession, d: str) -> DataFrame:
        return spark.sql("SELECT * FROM " + self._filled(f"parquet.`{d}/{self.base}.parquet`", f"VALUES {self.rows}"))

    def patterns(self, spark: SparkSession) -> DataFrame:
        """The patterns themselves, of no group."""
        told = [f"replace({c}, '#', '') AS {c}" if c in self.texts else c for c in self.names]
        return spark.sql(f"SELECT {', '.join(told)} FROM VALUES {self.rows} AS v(i, {', '.join(self.names)})")


#: A case in several instances under several forms of its number, cases with one instance, with a copy, and unknown courts.
DECISIONS = Derived(
    "doc_id, case_number, title, court, chamber, form, decided, resolution, snippet",
    """
    (1, '#757/123/23-ц', 'Рішення суду', 'Печерський районний суд міста Києва', '', 'Рішення', '2023-02-01', 'Позов задовольнити частково', ''),
    (2, '#757/123/2023-ц', 'Постанова', 'Київський апеляційний суд', '', 'Постанова', '2023-06-01', 'Рішення залишити без змін', ''),
    (3, '#757/123/2023', 'Постанова', 'Верховний Суд', 'КЦС ВС', 'Постанова', '2023-10-01', 'Рішення скасувати, справу направити на новий розгляд', ''),
    (3, '#757/123/2023', 'Постанова', 'Верховний Суд', 'КЦС ВС', 'Постанова', '2023-10-01', 'Рішення скасувати, справу направити на новий розгляд', ''),
    (4, '#910/7/2022', 'Рішення', 'Господарський суд міста Києва', '', 'Рішення', '2022-03-01', 'Відмовити у позові', ''),
    (5, '#910/7/22', '', 'Північний апеляційний господарський суд', '', '', '2022-08-01', 'Рішення суду змінено', 'Постанова по справі № #910/7/22 Північний апеляційний господарський суд'),
    (6, '#55/1/2021', 'Ухвала', 'Окружний суд', '', 'Окрема ухвала', '2021-05-05', 'Закрити провадження', ''),
    (7, '#77/9/2020', 'Вирок', 'Шевченківський районний суд', '', 'Вирок', '2020-01-10', 'Визнати винним', ''),
    (8, '#77/9/2020', 'Окрема думка', 'Шевченківський районний суд', '', '', '2020-02-10', NULL, ''),
    (9, '#88/2/2019', 'Рішення', 'Дарницький районний суд', '', 'Рішення', '2019-01-10', 'Позов задовольнити', ''),
    (10, '#88/2/19', 'Постанова', 'Верховний Суд', 'Велика Палата ВС', 'Постанова', '2020-01-10', 'Відмовити у задоволенні скарги', ''),
    (11, '#88/2/19', 'касаційна скарга', NULL, NULL, NULL, '2019-09-09', 'Рішення скасувати', NULL),
    (12, '#99/3/2018', 'Лист', NULL, NULL, NULL, '2018-01-01', 'Задовольнити', NULL),
    (13, '#99/3/2018', NULL, NULL, NULL, NULL, '2018-02-01', 'скасувати', 'Рішення районного суду: районний суд по справі № #99/3/2018 Районний суд<')
    """, base="orders", key="o_orderkey", size=14, ids="doc_id", texts="case_number, title, snippet")

#: Numbers that are asked for, one twice and two that no decision has.
NUMBERS = Derived("number", "('#757/123/23-ц'), ('#910/7/2022'), ('#55/1/21'), ('#77/9/2020'), ('#88/2/2019'), ('#99/3/2018'), ('#1/1/2001'), ('not a number'), ('#55/1/21')", base="orders", key="o_orderkey", size=14, texts="number")

#: Texts that cite cases by number.
TEXTS = Derived(
    "doc_id, case_number, text",
    """
    (1, '#757/123/2023', 'Суд посилається на постанову у справі #910/7/2022 та на справу № 55, а також #88/2/2019.'),
    (2, '#910/7/2022', 'Колегія не погоджується з висновком у справі #757/123/2023, оскільки обставини інші. Рішення № 12 тут ні до чого, дивись справа №  88'),
    (3, '#88/2/2019', 'Рішення у справі #757/123/2023 скасовано постановою.'),
    (4, '55', 'Без посилань.'), (5, NULL, NULL), (6, '#77/9/2020', ''),
    (7, '#12/1/2020', 'Двічі #910/7/2022 і знову #910/7/2022, і ще #500/1/1999.')
    """, base="customer", key="c_custkey", size=7, ids="doc_id", texts="case_number, text")

#: Court reasoning by topic: one topic with five rows, one with three, one with two, which is too few.
REASONING = Derived(
    "doc_id, topic, text",
    """
    (1, 'a#', 'Суд вважає: ст. 625 та ст. 16, позов задоволено, факт доведено, підтверджено доказами'),
    (2, 'a#', 'За ст. 625 ЦК позов задоволено, відповідач має право, ст. 625 застосовано'),
    (3, 'a#', 'У позові відмовлено: недостатньо доказів, пропущено строк, ст. 99'),
    (4, 'a#', 'Позивач виграв, вимога відповідає вимогам, ст.  625'),
    (5, 'a#', 'частково'),
    (6, 'b#', 'Відхилено, бо не доведено і не відповідає закону, Ст. 1'), (7, 'b#', 'Відмовлено, пропущено строк, Ст. 1'), (8, 'b#', 'Інше, ст. 1'),
    (9, 'c#', 'задоволено ст. 7'), (10, 'c#', 'задоволено ст. 7')
    """, base="customer", key="c_custkey", size=10, ids="doc_id", texts="topic")

#: Answers with their sources; the same claims are looked for in texts.
ANSWERS = Derived(
    "answer_id, answer, sources",
    """
    (1, 'Перше твердження спирається на справу #910/7/2022. Друге твердження не має жодного підґрунтя. Так.', '#910/7/2022|закон'),
    (2, 'Твердження з номером #1/2/2003 якого немає ніде. Ще одне довге твердження має джерело.', ''),
    (3, 'Коротко.', 'x'), (4, NULL, 'x'), (5, '', NULL),
    (6, 'Тут є посилання на норму права і на практику! Чи є тут щось іще, що варто знати?', 'інше')
    """, base="customer", key="c_custkey", size=6, ids="answer_id", texts="answer, sources")

#: Questions to a legal assistant.
QUESTIONS = Derived(
    "question_id, question",
    """
    (1, 'Яка правова позиція Верховного Суду щодо пені за ЦПК?'), (2, 'Строк апеляційного оскарження за ГПК, чеклист'), (3, 'Повернення позову без розгляду'),
    (4, 'Підсудність спору, КАС'), (5, 'Належність доказів та експертиза, таблиця'), (6, 'Забезпечення позову'), (7, 'Інфляційні та 3% річних, судові витрати'),
    (8, 'Неоднорідна практика: за/проти'), (9, 'Голосування депутата за законопроект'), (10, 'ЄДРПОУ боржника'), (11, 'Затримка доставки товару споживачу'),
    (12, 'Податкова накладна'), (13, 'Трудовий договір'), (14, 'Порівняння договорів, касація'), (15, 'велика палата підбірка'), (16, 'workflow для перевірки'), (17, 'Знайди у сховищі'),
    (18, 'Due   diligence компанії'), (19, ''), (20, NULL), (21, 'Перша інстанція, штраф')
    """, base="customer", key="c_custkey", size=21, ids="question_id", texts="")

#: Laws and their articles: a number with a suffix, one that is no number, an outdated version, a missing chapter.
LAWS = Derived("rada_id, title", "('#435-15', 'Цивільний кодекс'), ('#1618-15', 'Процесуальний кодекс'), ('#1-1', 'Без статей')", base="part", key="p_partkey", size=8, texts="rada_id, title")
ARTICLES = Derived(
    "rada_id, article_number, chapter, full_text, is_current",
    """
    ('#435-15', '354', '1', 'Позов та строк, позов', true), ('#435-15', '354-1', '1', 'Строк позову', true), ('#435-15', '9', NULL, 'Договір', true), ('#435-15', '625', '2', 'Пеня, строк', false),
    ('#435-15', 'Прикінцеві', NULL, 'Набрання чинності', true), ('#435-15', '10', '3', 'строк строк строк', true), ('#1618-15', '2', '1', 'Завдання, позов', true), ('#1618-15', '44', '1', NULL, true)
    """, base="part", key="p_partkey", size=8, texts="rada_id, full_text")
#: Open votes of a parliament: one member is missing in a vote.
VOTES = Derived(
    "vote_id, session_date, bill, votes",
    """
    (1, DATE '2024-01-10', '#1001', '{"#7":"За","#8":"Проти","#9":"Утримався"}'), (2, DATE '2024-01-10', '#1002', '{"#7":"Не голосував","#8":"За"}'),
    (3, DATE '2024-02-01', '#1001', '{"#7":"За","#8":"Не голосував","#9":"Проти"}'), (4, DATE '2024-02-02', NULL, '{}'), (5, DATE '2024-02-03', '#1003', NULL)
    """, base="customer", key="c_custkey", size=5, ids="vote_id", texts="bill, votes")
MEMBERS = Derived("member_id, name, faction, status, gender", "('#7', 'А', 'Фракція Слуга народу', 'чинний', 'ж'), ('#8', 'Б', 'Платформа за життя', 'чинний', 'ч'), ('#9', 'В', 'ОПЗЖ', 'припинено', 'ч'), ('#10', 'Г', 'ГОЛОС', 'чинний', 'ж'), ('#11', 'Д', NULL, 'чинний', NULL)", base="customer", key="c_custkey", size=5, texts="member_id")
#: Matters with retention, documents in them, and legal holds.
MATTERS = Derived("matter_id, closed, years, held, opposing, parties", "(1, DATE '2015-05-01', 5, false, 'ТОВ Альфа', '[\"Бета ЛТД\",\"Гамма\"]'), (2, DATE '2022-01-31', 5, false, 'Дельта', '[]'), (3, NULL, 7, false, NULL, NULL), (4, DATE '2010-01-01', 1, true, 'альфа груп', '[\"ПАТ Альфа-банк\"]')", base="customer", key="c_custkey", size=6, ids="matter_id")
PAPERS = Derived("paper_id, matter_id", "(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, NULL)", base="customer", key="c_custkey", size=6, ids="paper_id, matter_id")
HOLDS = Derived("hold_id, paper_id, matter_id, status", "(1, 2, NULL, 'active'), (2, 1, NULL, 'released'), (3, NULL, 4, 'active'), (4, 2, NULL, 'active'), (5, 6, NULL, 'released')", base="customer", key="c_custkey", size=6, ids="hold_id, paper_id, matter_id")
#: Decisions with the codes that a court search filters by.
COURTS = Derived("doc_id, instance_code, court_code, justice_kind", "(1, 1, '9901', 1), (2, 1, '9911', 1), (3, 2, '9901', 3), (4, 1, '2601', 2), (5, 3, '9951', 4), (6, 1, '9931', 3), (7, NULL, NULL, NULL)", base="orders", key="o_orderkey", size=7, ids="doc_id")
#: Paragraphs of a decision, as its page holds them.
PAGES = Derived(
    "page_id, html",
    """
    (1, '<html><body><div id="article-container"><p>Справа  № #1</p><p>УСТАНОВИВ: факти</p><p>Далі <b>факти</b></p><p> </p><p>ВИРІШИВ: позов задовольнити</p><p>решта</p><p>Суддя Іваненко</p><p>Кінець</p></div></body></html>'),
    (2, '<article><p>ВСТАНОВИВ: інше</p><p>УХВАЛИВ: відмовити</p></article>'), (3, '<article></article>'), (4, NULL), (5, '<p>поза статтею</p>')
    """, base="orders", key="o_orderkey", size=5, ids="page_id", texts="html")
#: Rich text with control words, Windows-1251 bytes and code points, and its plain text; the backslash is written as a vertical bar, tabs and ends of lines in plain texts as ^ and ~.
RICH = Derived("file_id, body, plain", "(1, '{|rtf1|ansi {|fonttbl{|f0 Arial;}}|par Hello|tab World #|par |u1057?|u1091?|u1076?}', 'Hello^ World #~ Суд'), (2, 'plain #', 'plain #'), (3, NULL, NULL), (4, '{|b bold #}|par|par|par|par end', 'bold #~~ end')", base="orders", key="o_orderkey", size=4, ids="file_id", texts="body, plain")
#: Names of court levels as callers write them.
LEVELS = Derived("level_id, value", "(1, 'Grand Chamber'), (2, 'вп'), (3, 'SC'), (4, 'Supreme Court #'), (5, 'КЦС ВС'), (6, 'cassation'), (7, '# апеляційний'), (8, 'first_instance'), (9, 'Перша інстанція #'), (10, 'щось #'), (11, ''), (12, NULL)", base="orders", key="o_orderkey", size=12, ids="level_id", texts="value")

#: Access keys: within their limit, over it, over it on an earlier day, expired, without end, switched off.
KEYS = Derived(
    "access, is_active, requests_today, reset_at, rate_limit, expires_at",
    """
    ('a#', TRUE, 5, DATE '2024-01-31', 10, TIMESTAMP '2025-01-01 00:00:00'),
    ('b#', TRUE, 10, DATE '2024-01-31', 10, NULL),
    ('c#', TRUE, 10, DATE '2024-01-30', 10, NULL),
    ('d#', TRUE, 1, DATE '2024-01-31', 10, TIMESTAMP '2024-01-30 00:00:00'),
    ('e#', FALSE, 1, DATE '2024-01-31', 10, NULL),
    ('f#', TRUE, 12, DATE '2024-01-31', 10, TIMESTAMP '2024-01-30 00:00:00'),
    ('g#', NULL, 0, NULL, 10, NULL)
    """, base="customer", key="c_custkey", size=8, texts="access")

#: Keys that are asked for, one that is unknown.
ASKED = Derived("access", "('a#'), ('b#'), ('c#'), ('d#'), ('e#'), ('f#'), ('g#'), ('zz#')", base="customer", key="c_custkey", size=8, texts="access")
