"""Training text of the models in residue.py: written from general knowledge of templates, error pages and commit
messages, varied by rule and a fixed seed. How well it carries to other wording is measured in README.md.

Three classes: what stands in for text (placeholders, untouched forms, filler), notices shown instead of text
(error pages and messages, demands for scripts), and natural prose, which also speaks about the first two.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import product

#: Names that templates of messages, forms and mails give to their fields.
FIELDS = tuple(
    "title name first_name last_name username user_id user email email_address author author-email committer subject summary description short-desc details body message content text comment note reason cause "
    "category label tag tags topic type kind scope module component package project repo repository branch version old_version new_version release date year time timestamp issue issue_id issue-number ticket ticket_id jira_key bug "
    "pr_number link url path file filename id number count status state priority severity owner reviewer approver assignee team company organization customer product change changes change_type what why how steps test plan risk".split()
) + ("your name", "your email", "full name", "issue number", "short summary", "long description", "commit message", "ticket number", "type of change", "release notes", "project name", "component name", "author name", "brief description")
#: Fields that stand where an author's name and address should.
NAMES = ("name", "author", "author_name", "author name", "user", "user_name", "username", "user.name", "first_name last_name", "full name", "your name", "committer_name", "NAME", "AUTHOR", "GIT_AUTHOR_NAME")
MAILS = ("email", "mail", "author_email", "author email", "user_email", "user.email", "email_address", "e-mail", "your email", "your@email", "committer_email", "EMAIL", "AUTHOR_EMAIL", "GIT_AUTHOR_EMAIL")
#: Signs that set a field off in template languages, shells, formats and forms.
SYNTAXES = (
    "{{{{ {0} }}}}", "{{{{{0}}}}}", "{{{{{{{0}}}}}}}", "${{{0}}}", "$({0})", "#{{{0}}}", "%({0})s", "%{0}%", "%{{{0}}}", "<%= {0} %>", "<% {0} %>", "<{0}>", "[{0}]", "[[{0}]]", "{{{0}}}", "{{% {0} %}}", "@{0}@", "@@{0}@@", "__{0}__", "«{0}»", "‹{0}›", "〈{0}〉", "【{0}】", "［{0}］",
    "<insert {0} here>", "[insert {0} here]", "[insert {0}]", "<your {0} here>", "[your {0}]", "(insert {0})", "<add {0}>", "[enter {0}]", "{{{0}}}.",
)
FRAMES = (
    "{a}", "{a}: {b}", "{a} - {b}", "{a} {b}", "{a}/{b}", "[{a}] {b}", "({a}) {b}", "{a} <{b}>", "{a}, {b}", "{a}({b}): {c}", "{a} {b} {c}", "{a}: {b} ({c})", "Update {a}", "Change {a} to {b}", "Release {a}", "Version {a}", "Fixes {a}", "Refs {a}", "See {a}", "Closes {a}", "Issue: {a}", "Ticket: {a}", "Author: {a}", "Type: {a}",
    "Reviewed-by: {a}", "Signed-off-by: {a} <{b}>", "Tested-by: {a}", "Release note: {a}", "Bump {a} to {b}", "Dear {a},", "Hello {a}",
)

FORMS = (
    "Your summary here", "Your description here", "Your text here", "Your title here", "Your message here", "Your name here", "Insert title here", "Insert description here", "Insert text here", "Enter a title", "Enter a title here", "Enter your commit message here", "Enter the description here", "Type your message here", "Write your message here",
    "Write a short summary here", "Add a description", "Add a description here", "Add your comment here", "Add details here", "Describe your changes", "Describe the change here", "Describe your change in detail", "Explain why this change is needed", "Replace this line", "Replace this with a summary", "Fill in the details", "Summary goes here", "Title goes here", "Description goes here", "Text goes here",
    "(fill in)", "(please fill in)", "(to be filled in)", "(to be completed)", "(to be added)", "(to be written)", "(your text)", "(none yet)", "<fill in>", "<please complete>", "[to be completed]", "[to be filled in]", "[add link]", "[add screenshots here]", "[describe the change]", "<describe the change>",
    "<!-- Describe your changes -->", "<!-- describe the problem -->", "<!-- Why is this needed? -->", "<!-- please fill in -->", "<!-- fill this in -->", "<!-- add steps -->", "<!-- what does this change? -->", "<!-- list of changes -->", "<!-- remove this line -->", "<!-- your text -->", "<!-- leave blank -->",
    "PROJ-000: your summary here", "TICKET-000: title", "JIRA-0000: short description", "ABC-000 summary of the change", "ISSUE-0: describe", "#000 your title here", "TODO: describe", "TODO: add a message", "TODO: write a description", "TODO write this", "TODO fill in", "FIXME: message", "TODO: summary", "TODO: fill in before merging",
    "<type>(<scope>): <subject>", "<type>: <description>", "type(scope): subject", "<body>", "<footer>", "[optional scope]: <description>", "[optional body]",
    "(bitte ausfüllen)", "<bitte ausfüllen>", "<!-- bitte ausfüllen -->", "[hier eintragen]", "Hier Text eingeben", "Hier Beschreibung einfügen", "[Beschreibung hier einfügen]", "<Titel eingeben>", "[Betreff einfügen]", "<Beschreibung eintragen>", "Titel hier eintragen", "[Kurzbeschreibung]", "<Name einsetzen>", "(noch zu ergänzen)", "Bitte Beschreibung ergänzen",
    "(à compléter)", "(à remplir)", "[à compléter]", "<!-- à remplir -->", "<!-- à compléter -->", "[insérer le titre]", "[insérer la description ici]", "<titre ici>", "Saisissez un titre", "Décrivez la modification", "<décrire le changement>", "[décrire ici]", "Votre texte ici", "[votre nom]", "<résumé à écrire>", "(description à ajouter)",
    "(por completar)", "(rellenar)", "[por completar]", "<!-- rellenar -->", "<!-- completar -->", "[insertar título]", "[insertar la descripción aquí]", "<título aquí>", "Escriba un título", "Describa el cambio", "<describir el cambio>", "[describir aquí]", "Su texto aquí", "[su nombre]", "<resumen por escribir>", "(título pendiente)", "(descripción pendiente)",
    "(未記入)", "(記入してください)", "（未入力）", "<!-- 記入してください -->", "<!-- ここに記入 -->", "［ここに記入］", "【件名】", "【タイトルを入力】", "〈概要〉", "〈件名〉", "ここに説明を入力してください", "ここにタイトルを入力", "ここに変更の説明を書いてください", "概要を入力してください", "件名を入力してください", "変更内容を記入してください", "(説明を記入)", "[名前を入力]",
)
FILLER = (
    "This is a placeholder.", "This is placeholder text.", "This is dummy text.", "This is sample text.", "This is filler text.", "This is just a test.", "Placeholder", "placeholder text", "Placeholder text, to be replaced.", "Dummy text", "Sample text", "Sample text goes here.", "Example text goes here.", "Text to be replaced later.", "Replace this text.", "Replace me", "Please replace this text before publishing.",
    "Content coming soon.", "Copy to follow", "Text to follow", "More text to come", "Body text here", "Heading", "Heading 0", "Headline here", "Title here", "Subtitle here", "Paragraph text.", "Your text here. Your text here.", "Sample message. Replace before saving.", "Example message, replace before you send.", "Some text. Some more text. Even more text.", "Section one", "Item one", "Item two", "Item three", "Heading three",
    "Dies ist ein Blindtext.", "Dies ist ein Platzhalter.", "Ein Blindtext steht hier, bis der richtige Text da ist.", "Hier steht bald ein Text.", "Das ist nur ein Beispieltext.", "Platzhaltertext, bitte ersetzen.", "Beispieltext, vor dem Speichern ersetzen.", "Mustertext",
    "Ceci est un texte de remplissage.", "Ceci est un faux texte.", "Ceci est un exemple de texte.", "Texte provisoire, à remplacer.", "Texte d'exemple à remplacer avant publication.", "Le texte viendra ici.", "Texte factice",
    "Este es un texto de relleno.", "Este es un texto de ejemplo.", "Texto provisional, hay que cambiarlo.", "Texto de muestra, cámbielo antes de enviar.", "Sustituya este texto antes de guardar.", "Aquí va el texto.", "Texto ficticio",
    "これはダミーテキストです。", "これはサンプルテキストです。", "ここにテキストが入ります。", "仮のテキストです。", "後で差し替えてください。", "テキストを置き換えてください。", "保存する前に書き換えてください。", "この文章はダミーです。", "サンプル文章です。",
    "The quick brown fox jumps over the lazy dog.", "foo bar baz", "foo bar baz qux quux", "abc def ghi", "abcdefghijklmnopqrstuvwxyz", "0000000000 abcdefghij", "aaa bbb ccc", "blah blah blah", "yada yada yada", "testing testing 0 0 0",
)
REPEATED = ("tbd", "tba", "xxx", "foo", "bar", "baz", "bla", "blah", "test", "testing", "text", "asdf", "qwerty", "qwer", "lorem", "ipsum", "dummy", "sample", "placeholder", "example", "todo", "aaa", "abc", "xyz", "n/a", "...", "---", "テキスト", "ダミー", "サンプル", "テスト", "あああ", "ああ", "texto", "texte", "prueba", "essai", "Blindtext")
#: Words of the classic mock Latin, as fixed by use.
LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum at vero eos accusam justo duo dolores ea rebum stet clita kasd gubergren no sea takimata sanctus diam nonumy eirmod invidunt aliquyam erat voluptua vivamus donec pellentesque habitant morbi tristique senectus "
    "netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget mauris placerat eleifend leo quisque semper libero nullam praesent dapibus neque cursus faucibus eros bibendum augue integer nec odio cras ornare phasellus rhoncus tellus aenean imperdiet etiam sagittis porttitor nunc ligula sodales "
    "tempora magnis dis parturient montes nascetur ridiculus mus magnam aliquam quaerat voluptatem nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi inventore veritatis quasi architecto beatae dicta explicabo"
).split()

STATUSES = {
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large", 414: "URI Too Long",
    415: "Unsupported Media Type", 416: "Range Not Satisfiable", 421: "Misdirected Request", 422: "Unprocessable Entity", 423: "Locked", 425: "Too Early", 428: "Precondition Required", 429: "Too Many Requests", 431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 507: "Insufficient Storage", 508: "Loop Detected", 511: "Network Authentication Required",
}
STATUS_FRAMES = (
    "{c} {s}", "{c}: {s}", "{c} - {s}", "Error {c}", "Error {c}: {s}", "Error {c} ({s})", "{s} ({c})", "HTTP {c}", "HTTP {c} - {s}", "HTTP Error {c}: {s}", "HTTP/1.1 {c} {s}", "HTTP/2 {c}", "Status: {c} {s}", "Error: {s}", "{s}", "{s}.", "{c} Error", "Server returned {c} {s}", "Request failed with status code {c}", "The remote server returned an error: ({c}) {s}.",
    '{{"error": "{s}"}}', '{{"error": {{"code": {c}, "message": "{s}"}}}}', '{{"message": "{s}"}}', '{{"message":"{s}","status":{c}}}', '{{"error":"{s}"}}', '{{"error":{{"message":"{s}"}}}}', '{{"error":{{"status":{c},"message":"{s}"}}}}', '{{"error":{{"code":{c},"message":"{s}","errors":[]}}}}', '{{"ok":false,"error":{{"code":{c},"text":"{s}"}}}}', '{{"fault":{{"code":"{c}","reason":"{s}"}}}}', '{{"status": {c}, "error": "{s}", "request_id": "0a0b0c0d"}}', '{{"code":{c},"reason":"{s}","detail":null}}', '{{"errors":[{{"status":"{c}","title":"{s}"}}]}}',
    "<Error><Code>{x}</Code><Message>{s}</Message></Error>", "<Error><Code>{x}</Code><RequestId>0a0b0c0d</RequestId><HostId>0a0b0c0d</HostId></Error>", "<error>{s}</error>", "<title>{c} {s}</title>", "<title>{s}</title>", "<head><title>{c} {s}</title></head>", "<h1>{c} {s}</h1>", "<h1>{s}</h1>", "<h2>Error {c}</h2>", "<center><h1>{c} {s}</h1></center>", "<p>{c} {s}</p>",
)
_THINGS = (
    "page", "web page", "site", "page you are looking for", "page you requested", "requested page", "requested URL", "requested resource", "requested file", "resource", "document", "file", "object", "repository", "project", "commit", "commit list", "diff", "patch", "comparison", "branch", "content", "link", "server", "service", "request", "view", "application", "data",
)
_FATES = (
    "was not found", "was not found on this server", "could not be found", "cannot be found", "does not exist", "no longer exists", "has been moved", "has been removed", "has been moved or deleted", "has been deleted", "may have been moved", "is not available", "is unavailable", "is temporarily unavailable", "is currently unavailable", "is no longer available",
    "could not be loaded", "failed to load", "took too long to load", "took too long to respond", "did not respond", "is not responding", "timed out", "has timed out", "could not be displayed", "cannot be displayed", "could not be shown", "could not be completed", "could not be processed", "could not be reached", "could not be served", "could not be rendered", "was denied", "was rejected",
    "was refused", "was blocked", "could not be drawn", "could not be built", "could not be read", "could not be opened", "is too large to display", "encountered an error", "encountered an internal error", "is overloaded", "is down", "is down for maintenance", "requires authentication", "is private", "is restricted", "returned an error", "returned an invalid response", "received no answer from the upstream server",
)
_CAUSES = {
    "en": (
        "Something went wrong.", "Something went wrong on our end.", "Something broke.", "Something failed on our side.", "An error occurred.", "An error has occurred.", "An unexpected error occurred.", "An unexpected problem occurred.", "An internal error occurred.", "Unexpected error.", "Unknown error.", "Internal error.", "Fatal error.", "Application error", "Server error.", "Oops!", "Oops! Something went wrong.", "Whoops, looks like something went wrong.", "Sorry!",
        "We're sorry.", "Sorry about that.", "Sorry, we can't find that page.", "We couldn't find that page.", "We could not load this page.", "We could not process your request.", "We are having trouble.", "Page not found.", "File not found.", "Not found.", "Nothing here.", "Access denied.", "Access forbidden.", "Permission denied.", "Not authorized.", "Login required.", "Authentication required.", "Authentication failed.", "Bad credentials.", "Invalid token.",
        "You do not have permission to view this page.", "You do not have access to this repository.", "You don't have permission to access this resource.", "You are not authorized to view this page.", "You are not logged in.", "You are not allowed to do this.", "You lack permission to see this.", "You have been logged out.", "You have been signed out.", "You have exceeded your quota.", "You have reached the limit of requests.", "You have sent too many requests.",
        "This repository is private.", "This page is private.", "This project is not public.", "This page is restricted to members.", "Your session has expired.", "Your session has timed out.", "Your session has ended.", "Your login has expired.", "Your token has expired.", "Your request was blocked.", "Your request could not be completed.", "Your request timed out.", "Your IP address has been blocked.", "Session expired.", "Too many requests.", "Too many attempts.",
        "Rate limit exceeded.", "API rate limit exceeded.", "Request limit reached.", "Hourly quota used up.", "Slow down.", "Connection timed out.", "Connection refused.", "Connection reset by peer.", "Service unavailable.", "Bad gateway.", "Gateway timeout.", "Temporarily unavailable.", "Under maintenance.", "Down for maintenance.", "Scheduled maintenance.", "The site is undergoing maintenance.", "We are performing scheduled maintenance.", "This service is offline for planned work.", "This system is being updated.", "The server is read-only for now.",
    ),
    "de": (
        "Zugriff verweigert.", "Zugang gesperrt.", "Keine Berechtigung.", "Sie haben keine Berechtigung für diese Seite.", "Seite nicht gefunden.", "Die Seite wurde nicht gefunden.", "Die angeforderte Seite existiert nicht.", "Die Seite konnte nicht geladen werden.", "Die Anfrage konnte nicht bearbeitet werden.", "Es ist ein Fehler aufgetreten.", "Ein unerwarteter Fehler ist aufgetreten.", "Interner Serverfehler.", "Fehler 000", "Fehler 000:",
        "Zu viele Anfragen.", "Dienst nicht verfügbar.", "Der Dienst ist zurzeit nicht verfügbar.", "Ihre Sitzung ist abgelaufen.", "Die Sitzung ist abgelaufen.", "Sie wurden abgemeldet.", "Anmeldung erforderlich.", "Zeitüberschreitung.", "Wartungsarbeiten.", "Wegen Wartung nicht erreichbar.",
    ),
    "fr": (
        "Accès refusé.", "Accès interdit.", "Vous n'avez pas l'autorisation.", "Vous n'avez pas accès à cette page.", "Page introuvable.", "Page non trouvée.", "La page demandée n'existe pas.", "La page n'a pas pu être chargée.", "La page ne peut être affichée.", "La requête n'a pas abouti.", "Une erreur est survenue.", "Une erreur inattendue s'est produite.", "Erreur interne du serveur.", "Erreur 000", "Erreur 000 :",
        "Trop de requêtes.", "Service indisponible.", "Service temporairement indisponible.", "Votre session a expiré.", "La session a expiré.", "Vous avez été déconnecté.", "Connexion requise.", "Délai dépassé.", "Maintenance en cours.", "Site en maintenance.",
    ),
    "es": (
        "Acceso denegado.", "Acceso prohibido.", "No tiene permiso.", "No tiene permiso para ver esta página.", "Página no encontrada.", "No se encontró la página.", "La página solicitada no existe.", "No se pudo cargar la página.", "No se puede mostrar la página.", "No se pudo completar la solicitud.", "Se ha producido un error.", "Ocurrió un error inesperado.", "Error interno del servidor.", "Error 000", "Error 000:",
        "Demasiadas solicitudes.", "Demasiadas peticiones.", "Servicio no disponible.", "El servicio no está disponible.", "Su sesión ha caducado.", "La sesión ha expirado.", "Se ha cerrado su sesión.", "Debe iniciar sesión.", "Tiempo de espera agotado.", "En mantenimiento.", "Sitio en mantenimiento.",
    ),
    "ja": (
        "アクセスが拒否されました。", "アクセス権限がありません。", "このページを表示する権限がありません。", "ページが見つかりません。", "お探しのページは見つかりませんでした。", "指定されたページは存在しません。", "ページを読み込めませんでした。", "ページを表示できません。", "リクエストを処理できませんでした。", "エラーが発生しました。", "予期しないエラーが発生しました。", "サーバーエラーが発生しました。", "エラー 000", "エラー: 000", "リクエストが多すぎます。", "アクセスが集中しています。",
        "サービスは現在ご利用いただけません。", "サービスを利用できません。", "セッションの有効期限が切れました。", "セッションがタイムアウトしました。", "ログアウトしました。", "ログインが必要です。", "タイムアウトしました。", "メンテナンス中です。", "ただいまメンテナンス中です。",
    ),
}
_NEXT = {
    "en": (
        "Please try again.", "Please try again later.", "Try again later.", "Try again in a few minutes.", "Please wait 00 seconds and try again.", "Retry after 00 seconds.", "Wait 0 minutes and retry.", "Please reload the page.", "Reload the page.", "Refresh the page.", "Go back.", "Go back to the home page.", "Return to the home page.", "Back to start", "Please log in.", "Log in to continue.", "Please log in again.", "Sign in to continue.", "Sign in again.",
        "Sign in with a different account.", "You need to sign in to see this page.", "You must be logged in to view this page.", "Contact the administrator.", "Contact support if the problem persists.", "Ask the owner for access.", "Check the address and try again.", "Our team has been notified.", "The team has been informed.", "The developers have been told.", "Someone has been told about it.", "The team was told.", "Go to the start page.", "Go back to the main page.", "Back to the first page.", "We can't show what you asked for.", "What you wanted could not be shown.", "Wait a minute and repeat your request.", "Try again in 00 seconds.", "Your address is host.example.", "Your address: 0.0.0.0", "We have been notified.", "The administrators have been informed.", "We will be back soon.", "We'll be right back.", "Thank you for your patience.", "Thanks for waiting.",
        "Request ID: 0a0b0c0d", "Reference: 0a0b0c0d", "Error reference 0a0b0c0d", "(error 0a0b0c0d)", "Trace ID 0a0b0c0d", "Incident 0a0b0c0d", "Your IP: 0.0.0.0", "Your address: host.example", "Nothing could be shown.", "We could not show this page.", "This page stopped working.",
    ),
    "de": ("Bitte versuchen Sie es erneut.", "Bitte versuchen Sie es später noch einmal.", "Versuchen Sie es später wieder.", "Bitte melden Sie sich an.", "Melden Sie sich erneut an.", "Bitte laden Sie die Seite neu.", "Zurück zur Startseite", "Wenden Sie sich an den Administrator.", "Die angeforderte Seite kann nicht angezeigt werden.", "Referenz 0a0b0c0d", "Fehlernummer 0a0b0c0d", "Kennung: 0a0b0c0d"),
    "fr": ("Veuillez réessayer.", "Veuillez réessayer plus tard.", "Réessayez dans quelques minutes.", "Veuillez vous connecter.", "Connectez-vous à nouveau.", "Veuillez recharger la page.", "Retour à l'accueil", "Contactez l'administrateur.", "La page demandée ne peut pas être affichée.", "Référence : 0a0b0c0d", "Numéro d'erreur 0a0b0c0d", "Référence 0a0b0c0d"),
    "es": ("Inténtelo de nuevo.", "Inténtelo de nuevo más tarde.", "Vuelva a intentarlo en unos minutos.", "Inicie sesión.", "Inicie sesión para continuar.", "Inicie sesión otra vez.", "Vuelva a cargar la página.", "Volver al inicio", "Póngase en contacto con el administrador.", "No se puede mostrar la página solicitada.", "Referencia: 0a0b0c0d", "Número de error 0a0b0c0d", "Referencia 0a0b0c0d"),
    "ja": ("もう一度お試しください。", "後でもう一度お試しください。", "時間をおいて再度お試しください。", "ログインしてください。", "再度ログインしてください。", "ページを再読み込みしてください。", "トップページへ戻る", "管理者にお問い合わせください。", "ご要求のページを表示できません。", "参照番号 0a0b0c0d", "(エラー番号 0a0b0c0d)", "(0a0b0c0d)"),
}
DOWN = tuple(f"{a} {b}" for a, b in product(
    ("We are down for maintenance", "We are currently performing maintenance", "The site is down for maintenance", "This site is under maintenance", "Scheduled maintenance in progress", "Planned maintenance is under way", "The service is offline for an upgrade", "The server is being upgraded", "The system is read-only during maintenance", "We are upgrading our servers", "This service is paused"),
    ("and will be back soon.", "and will be back shortly.", "and will return later today.", "until further notice.", "until tomorrow.", "until 00:00.", "- please check back later.", "; thank you for your patience.", "; please try again later."),
))
_JS = ("JavaScript", "Javascript", "scripts", "scripting", "client-side scripts", "JavaScript and cookies")
SCRIPTS = (
    *(f"{a} {b} {j} {c}" for a, b, j, c in product(
        ("Please", "You need to", "You must", "To continue, please", "To use this site,", "In order to proceed,", "Kindly"), ("enable", "turn on", "allow", "activate", "switch on"), _JS,
        ("in your browser.", "to continue.", "to view this page.", "to use this site.", "to run this app.", "and reload the page.", "and refresh.", "to see this content.", "to see the full page.", "for full access.", "for the complete page.", "for the whole site."))),
    *(f"{a} {b} {j}{c}" for a, b, j, c in product(
        ("This page", "This site", "This website", "This application", "This app", "This viewer", "The content", "The editor", "The browser view"), ("requires", "needs", "relies on", "does not work without", "works only with", "will not work without", "requires a browser with"), _JS, (".", " to work.", " to display.", " to be enabled.", " to function properly.", " turned on."))),
    *(f"{j} {a} {b} {c}" for j, a, b, c in product(
        ("JavaScript", "Javascript", "Scripting", "Active scripting"), ("is disabled", "is turned off", "is switched off", "is blocked", "is not enabled", "is not available", "is required", "is not supported", "must be enabled"), ("in your browser.", "in this browser.", "for this page.", "for this site.", "here."),
        ("Please enable it.", "Enable it to continue.", "Turn it on and reload.", "Switch it on to see this page.", "Nothing will be shown without it."))),
    *(f"{a} {b}" for a, b in product(
        ("Checking your browser before accessing the site.", "Checking your browser...", "Please wait while we verify your browser.", "Please wait, checking your connection.", "Verifying that you are human.", "Verifying you are not a robot.", "Just a moment...", "One moment please.", "Please stand by while we check your request.", "Are you a robot?"),
        ("This may take a few seconds.", "JavaScript is required.", "Please enable JavaScript and cookies.", "JavaScript and cookies must be enabled.", "Please allow scripts.", "Scripts must be allowed until this check ends.", "You will be redirected shortly."))),
    *(f"{a} {j} {b}" for a, j, b in product(("Bitte aktivieren Sie", "Bitte schalten Sie", "Aktivieren Sie", "Bitte erlauben Sie"), ("JavaScript", "Skripte"), ("in Ihrem Browser.", "ein, um fortzufahren.", "und laden Sie die Seite neu.", "um diese Seite anzuzeigen."))),
    *(f"{a} {j} {b}" for a, j, b in product(("Diese Seite benötigt", "Diese Anwendung braucht", "Zum Anzeigen wird benötigt:"), ("JavaScript", "Skripte"), (".", "und Cookies.", "zum Anzeigen."))), "JavaScript ist deaktiviert.", "JavaScript einschalten und Seite neu laden.", "Skripte müssen erlaubt sein.",
    *(f"{a} {j} {b}" for a, j, b in product(("Veuillez activer", "Activez", "Vous devez activer", "Merci d'autoriser", "Il est nécessaire d'activer"), ("JavaScript", "les scripts"), ("dans votre navigateur.", "pour continuer.", "pour afficher cette page.", "puis rechargez la page."))),
    *(f"{a} {j}{b}" for a, j, b in product(("Cette page nécessite", "Ce site a besoin de", "L'affichage demande"), ("JavaScript", "les scripts"), (".", " et les cookies.", " pour fonctionner."))), "JavaScript est désactivé.",
    *(f"{a} {j} {b}" for a, j, b in product(("Active", "Habilite", "Por favor, active", "Debe activar", "Es necesario permitir"), ("JavaScript", "los scripts"), ("en su navegador.", "para continuar.", "para ver esta página.", "y vuelva a cargar la página."))),
    *(f"{a} {j}{b}" for a, j, b in product(("Esta página necesita", "Este sitio requiere", "La vista requiere"), ("JavaScript", "scripts"), (".", " y cookies.", " para funcionar."))), "JavaScript está desactivado.",
    *(f"{a}{j}{b}" for a, j, b in product(("このページを表示するには", "続行するには", "このサイトを利用するには", "閲覧するには", "ブラウザの設定で"), ("JavaScript を", "JavaScriptを", "スクリプトを"), ("有効にしてください。", "許可してください。", "オンにする必要があります。", "有効にして再読み込みしてください。"))), "JavaScript が無効になっています。", "JavaScript が必要です。",
)
PAGES = ("<html>", "</html>", "<html><body>", "</body></html>", "<body>", "</body>", "<head>", "</head>", "<hr>", "<hr><center>nginx</center>", "<hr><address>Apache/0.0 (Unix) Server at host.example Port 00</address>", "<center>openresty</center>", "<p></p>", "<!DOCTYPE html>", "<!DOCTYPE HTML PUBLIC>", '<html lang="en">', '<meta charset="utf-8">', "<center><h1>", "</h1></center>", "<hr>server/0.0", "<hr>apache/0.0", "<hr>nginx/0.0.0", "<noscript>", "</noscript>")

VERBS = "Add Fix Remove Rename Rework Simplify Split Guard Document Speed up Update Move Replace Use Make Allow Drop Handle Test Cache Merge Bump Revert Improve Refactor Log Check Parse Return Store Skip Sort".replace("Speed up", "Speed_up").split()
OBJECTS = (
    "the {w} cache", "{w} parser", "tests of {w}", "error path in {w}", "{w} lookup in {v}", "rounding of {w} totals", "unused {w} flag", "{w} retries for {v}", "the {w} table", "a missing index on {w}", "logging of {w}", "the reader of {w} files", "dead code in {w}",
    "the {w} module", "a race in {w}", "support for {w}", "the default of {w}", "types of {w}", "docs for {w}", "the build of {w}",
)
SENTENCES = (
    "Measured on the {w} sample: about 0000 ms less per call.", "Closes #0000.", "The old code read {w} twice and kept the second value.", "This keeps {w} and {v} in step.", "No change for users of {w}.", "This makes {w} and {v} agree.", "This moves {w} to {v}.", "This avoids a second read of {w}.", "This lets {w} run before {v}.", "This brings {w} and {v} in line.", "Return 404 from {w} when the {v} is unknown.",
    "Callers of {w} saw stale rows after a restart.", "Reviewed together with the {w} owners.", "This commit was made by a robot.", "The new order makes the {w} easier to read.", "See the notes of {w} for the reasons.", "It was only used by {w}, which is gone.",
    "Der alte Weg las {w} doppelt.", "Erledigt #000.", "Für Nutzer von {w} ändert sich nichts.", "Nach dem Neustart fehlten Zeilen in {w}.", "Behebe {w} in {v}", "Überarbeite Rundung der {w}-Summen", "Prüfe Fehlerpfad in {w}", "Ergänze Suche nach {w} in {v}", "Entferne den {w}-Puffer",
    "El código viejo leía {w} dos veces.", "Sin cambios para {w}.", "Cierra #000.", "Añade las pruebas de {w}", "Corrige el redondeo de {w}", "Ordena la búsqueda de {w} en {v}", "Quita la caché de {w}",
    "L'ancien code lisait {w} deux fois.", "Ferme #000.", "Rien ne change pour {w}.", "Mesuré : 0000 ms de moins.", "Ajoute l'arrondi des totaux {w}", "Corrige la recherche de {w} dans {v}", "Simplifie le cache {w}", "Supprime les essais de {w}",
    "以前は {w} を二回読んでいた。", "#000 を閉じる。", "{w} の利用者には影響なし。", "修正: {w} キャッシュ", "追加: {w} のテスト", "整理: {w} 合計の丸め", "削除: {w} の {v} 検索",
    "Merge main into {w}", "Merge branch '{w}' into main", "Merge commit '0a0b0c'", "Merge tag 'v0.0' into {w}", "Merge pull request #000 from {w}/{v}", "Merge remote-tracking branch 'origin/{w}'", "Conflicts:", "src/{w}.py", "Run the formatter", "fix indent", "Tidy white space", "Reformat",
    "[skip ci] regenerate {w} lock file", "build #0000 passed", "Backup 0000", "Automatic snapshot 0000", "Update generated docs", "Sync translations from {w}", "release: v0.000.0", "chore(deps): update {w} to v000", "Bump {w} from 0.0 to 0.0.0", "core: {w}", "ui: {w}", "fix({w}): {v}", "feat({w}): {v}", "[{w}] {v}",
    "## What does this change?", "## How was it tested?", "- [ ] docs", "- [ ] tests", "- [x] tests", "## Was wird geändert?", "## Wie wurde geprüft?", "## Quoi ?", "## Pourquoi ?", "## ¿Qué cambia?", "## ¿Cómo se probó?", "## 変更内容", "## 確認方法", "## Summary", "## Why",
    "{W} {V} <{w}.{v}@corp.example>", "{W} {V}", "{w}.{v}", "{W}-bot <bot@ci.example>", "bot", "{w}@mail.example", "Signed-off-by: {W} {V} <{w}@dev.example>", "Reviewed-by: {W} {V} <{w}.{v}@corp.example>", "Co-authored-by: {W} {V} <{v}@mail.example>", "Ticket: 0000", "Refs #000",
)
#: Prose that speaks about residue: r is the place of a piece of residue, w and v are names, c and d status codes, s the text of c.
ABOUT = (
    'Fix "{r}" in {w}', 'Fix "{r}" for large {w} files', 'Fix "{r}" of big {w} tables', "Fix the loading of large {w} diffs", 'Show "{r}" when {w} fails', 'Translate "{r}" for the {w} page', 'Test that {w} answers "{r}"', 'Do not log "{r}" twice in {w}', 'Reword "{r}" in {w}', 'Drop "{r}" from the fixtures of {w}', "Map {r} to {v} in {w}", "Support {r} in templates of {w}", "Escape {r} in {w}", "Reject messages of {w} that hold {r}",
    "Replace {r} with the name of {w}", "Remove the placeholder {r} from {w}", "Quote {r} in error texts of {w}", "Warn about {r} in {w}", "Handle {r} from {w}", "Retry {w} after {r}", "Explain {r} in the docs of {w}", "Parse `{r}` in {w}", "Return {r} from {w} for unknown {v}", "The {w} test covers {r} as well", "Rename the {r} check in {w}",
    "Answer {c} when {w} is down", "Answer {c} until {w} has started", "Send {c} instead of {d} from {w}", "Return {c} while {v} restarts", "Map {c} of {w} to an empty list", "Treat {c} from {w} as final", "Retry {w} on {c} and {d}", "Log the {c} page of {w}", "Use status {c} for {w}", 'Show "{c} {s}" of {w} only once', 'Return "{s}" after {d} tries of {w}', "Say why {w} needs JavaScript", "Say in {w} why scripts are needed", "Explain why {w} needs cookies", "Warn if JavaScript is off in the {w} form", "Warn users of {w} that scripts are blocked",
    "Refuse commits that still hold {r}", "Refuse titles of {w} with {r}", "Fill the defaults of {w}", "Replace foo and bar in the tests of {w}", "Use real names for foo and bar in {w}", "Rename the test {w} data", "Let the hook of {w} look for {r}", "Accept both {r} and {w}", "Teach {w} the syntax of {r}", "Show a notice in {w} when {v} is missing", 'Say "{r}" in the mails of {w}',
    "Add a test for the error page of {w}", "Return a proper status when {w} is missing", "Retry {w} on a timeout of {v}", "Use a clearer error text in {w}", "Tell users of {w} why scripts are needed", "Let {w} work without JavaScript", "Remove dummy text from the {w} page", "Delete placeholder rows of {w}", "Render the maintenance page of {w} from a template", "Keep error pages of {w} out of the cache",
    "Check for unfilled placeholders in {w}", "Warn when a {w} form is left blank", "Log failed logins of {w}", "Cover expired sessions in {w}", "Count refused requests of {w}", "Document the rate limit of {w}", "Make the lorem ipsum of {w} shorter", "Allow brackets in names of {w}", "Expand variables in the {w} config", "Ignore template files of {w} in the search", "Strip HTML from the errors of {w}",
)


def _word(r: random.Random) -> str:
    """An invented identifier of two to four syllables, at times with one of them twice."""

    def syllable() -> str:
        onset = r.choice("bcdfghklmnprstvwyz") if r.random() < 0.8 else r.choice(("dr", "br", "th", "tr", "st", "kr", ""))
        return onset + r.choice("aeiou") + r.choice(("", "", "", "", "l", "n", "r", "s", "m", "th"))

    def part() -> str:
        return syllable() * r.choice((1, 1, 1, 1, 1, 2)) + "".join(syllable() for _ in range(r.randint(1, 2)))

    return part() + (r.choice("._") + part() if r.random() < 0.3 else "")


def stand_ins(seed: int = 7) -> Iterator[str]:
    r = random.Random(seed)
    for syntax in SYNTAXES:
        for field in FIELDS:
            yield syntax.format(r.choice((field, field, field.upper(), field.title())))
        for _ in range(40):
            yield f"{syntax.format(r.choice(NAMES))} <{syntax.format(r.choice(MAILS))}>"
        for frame in FRAMES:
            for _ in range(4):
                up = r.random() < 0.35
                a, b, c = (syntax.format(x.upper() if up else x) for x in r.sample(FIELDS, 3))
                yield frame.format(a=a, b=b, c=c)
    for _ in range(3):
        yield from FORMS
        yield from FILLER
    for w in REPEATED * 2:
        for n in (1, 2, 3, 4, 6, 8, 12, 16, 20, 24):
            yield " ".join([w] * n)
    for _ in range(400):
        words = [r.choice(LATIN) for _ in range(r.randint(5, 25))]
        yield " ".join(words).capitalize() + r.choice((".", "", ","))
    for _ in range(200):  # keys struck at random
        row = r.choice(("asdfghjkl", "asdfghjkl", "asdfjkl", "qwertyuiop", "zxcvbnm"))
        yield " ".join("".join(r.choice(row) for _ in range(r.randint(3, 9))) for _ in range(r.randint(2, 9)))


def notices(seed: int = 8) -> Iterator[str]:
    r = random.Random(seed)
    for (code, text), frame in product(STATUSES.items(), STATUS_FRAMES):
        yield frame.format(c=code, s=text, x=text.replace(" ", ""))
    said = [f"{r.choice(('The', 'The', 'This', 'Your', 'That'))} {a} {b}." for a, b in product(_THINGS, _FATES)]
    yield from said * 2
    for lang, causes in _CAUSES.items():
        for cause, nxt in product(causes, _NEXT[lang]):
            if lang != "en" or r.random() < 0.3:
                yield f"{cause} {nxt}"
        for s in (*causes, *_NEXT[lang]):
            for frame in ("{0}", "{0}", "{0}", "<h1>{0}</h1>", "<p>{0}</p>", "<title>{0}</title>"):
                yield frame.format(s)
    for s in said:
        if r.random() < 0.25:
            yield f"{s} {r.choice(_NEXT['en'])}"
        if r.random() < 0.1:
            yield f"<p>{s}</p>"
    yield from DOWN
    others = SCRIPTS.index("Bitte aktivieren Sie JavaScript in Ihrem Browser.")  # English has many more
    for s in (*r.sample(SCRIPTS[:others], 1200), *SCRIPTS[others:] * 2):
        yield s
        if r.random() < 0.2:
            yield f"<noscript>{s}</noscript>"
        if r.random() < 0.1:
            yield f"<p>{s}</p>"
    yield from PAGES * 6


def prose(seed: int = 9) -> Iterator[str]:
    r = random.Random(seed)

    def fill(s: str, residue: str = "") -> str:
        w, v, c, d = _word(r), _word(r), r.choice(list(STATUSES)), r.choice(list(STATUSES))
        return s.format(w=w, v=v, r=residue, c=c, d=d, s=STATUSES[c], W=w.split(".")[0].split("_")[0].capitalize(), V=v.split(".")[0].split("_")[0].capitalize())

    for verb in VERBS:
        for o in OBJECTS:
            for _ in range(2):
                text = f"{verb.replace('_', ' ')} {fill(o)}"
                yield text
                yield f"{r.choice(('core', 'ui', 'fix(' + _word(r) + ')', '[' + _word(r) + ']'))}{r.choice((': ', ' '))}{text}"
    for s in SENTENCES:
        for _ in range(40):
            yield fill(s)
    for s in ABOUT:
        for _ in range(40):
            # what is said about a piece of residue is prose, the piece isn't
            yield from (x for x in fill(s, "\0").split("\0") if x.strip(" \"`"))
    for _ in range(600):
        yield " ".join(_word(r) for _ in range(r.randint(1, 4)))
