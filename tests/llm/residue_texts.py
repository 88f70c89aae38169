"""Held-out texts for the residue detector: written from general knowledge, without looking
at the test tables or at the detector's exemplars."""

from __future__ import annotations

from itertools import islice, product

_SLOTS = ["{{ name }}", "{{customer.firstName}}", "{customer_name}", "{venue}", "${orderTotal}", "%FIRST_NAME%", "%event%", "$AUTHOR_NAME$", "<%= user.email %>", "{% block intro %}", "[CUSTOMER NAME]", "[insert date here]", "[Your Company]", "__TITLE__", "@@REGION@@", "*|FNAME|*", "[[product]]", "<FIRST_NAME>", "#{title}", "{0}"]
_FRAMES = ["Dear {}, thank you for choosing our bakery for your party.", "The ferry to {} leaves twice a day and takes about an hour.", "Written by {} after a long week in the mountains.", "Our new album with {} is out now. Recorded over three nights in an old church.", "Please meet {} at the north entrance, we open the doors at noon.", "We planted forty apple trees last spring. Harvest notes were kept by {}.", "Tickets for {} cost eight euros.", "Join {} on a walk along the river and learn which mushrooms are safe to eat.", "A big thank you goes to {} who carried the camera up the hill.", "Welcome to {}! The kitchen stays open late."]
_MISSING = ["Hosted by undefined with music from the village band.", "Name: undefined, age: NaN", "Hello null, your weekly summary of garden news is here.", "Running time: NaN minutes. We walk through the whole recipe.", "Director: null. Camera: Lea Brandt.", "Dear undefined, thanks for joining the running club.", "Posted on undefined in Woodwork.", "Location: [object Object]. Bring warm clothes.", "Rating: NaN / 5 from all visitors of the museum.", "This episode was edited by null.", "Price: $NaN per person including lunch.", "Views: NaN. Published last summer.", "Duration: undefined", "Hi undefined! Here are three songs we picked for you.", "Welcome back, null. You left two items in your basket.", "Guest: undefined. We talk about bees and the long winter.", "The concert in undefined starts at eight.", "Only NaN seats left for the harbour tour.", "Narrated by undefined, filmed in the old mill.", "Reviewed by null on Tuesday, the soup was salty."]
_FILLER = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.", "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.", "test test test", "Testing 1 2 3", "asdf asdf asdf asdf", "qwerty qwerty", "Your text goes here.", "This is a sample paragraph. Replace it with your own content.", "Add your description here.", "Placeholder text. Do not publish.", "blah blah blah", "foo bar baz", "This is dummy text.", "Sample text sample text sample text", "Enter your text here", "Content coming soon.", "xxxx xxxx xxxx", "Click here to edit this text."]
_SCRIPT = ["Please enable JavaScript to view this page.", "JavaScript is disabled in your browser. Please enable it to continue.", "You need to enable JavaScript to run this app.", "This website requires JavaScript.", "Enable JavaScript and cookies to continue", "Just a moment... Verify you are human by completing the action below.", "Checking if the site connection is secure", "Checking your browser before accessing the website.", "Please confirm you are not a robot.", "Your browser does not support JavaScript.", "For full functionality of this site it is necessary to enable JavaScript.", "We've detected that JavaScript is disabled in this browser.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Veuillez activer JavaScript dans votre navigateur pour continuer.", "Por favor, habilita JavaScript en tu navegador.", "Per visualizzare questa pagina è necessario attivare JavaScript.", "Ative o JavaScript para ver esta página.", "Schakel JavaScript in om deze pagina te bekijken.", "Cookies must be enabled to use this site. Please turn on cookies and reload the page.", "Complete the security check to access the site. Why do I have to complete a CAPTCHA?"]
_ERROR = ["404 Not Found", "500 Internal Server Error. The server encountered an unexpected condition.", "502 - Web server received an invalid response while acting as a gateway or proxy server.", "This content isn't available in your country.", "Page not found. The page you are looking for might have been removed or had its name changed.", "Access denied. You don't have permission to access this resource.", "Video unavailable. This video is private.", "503 Service Unavailable. No server is available to handle this request.", "Something went wrong. Please try again later.", "java.io.FileNotFoundException: Response '404: Not Found' for url", "Error establishing a database connection", "Your session has timed out. Please log in again.", "We're sorry, but the page you requested was not found.", "This site can't be reached. The connection was reset.", "Too many requests. Please try again in a few minutes.", "The requested URL was not found on this server.", "Sorry, this video has been removed by the user.", "Oops! That page can't be found.", "Die Seite wurde nicht gefunden.", "La pagina richiesta non è stata trovata.", "La página que buscas no existe.", "Une erreur est survenue. Veuillez réessayer plus tard.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "We are currently down for scheduled maintenance. Please check back soon.", "Traceback (most recent call last): File \"app.py\", line 12, in <module>", "Forbidden. You don't have permission to access / on this server.", "Request timed out. The server took too long to respond.", "Your request could not be processed. Reference number 18.2f3c", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "Unexpected error. Contact the administrator if the problem persists."]
_PLAIN = ["The {n} leaves the harbour before sunrise and returns with the tide.", "My grandmother kept the {n} in a blue tin above the stove.", "Nobody expected the {n} to win, but the crowd cheered anyway.", "After the storm we found the {n} in the neighbour's garden.", "Cut the {n} into thin slices and let them rest in salted water.", "The museum shows a {n} from the sixteenth century.", "In winter the {n} is covered with snow for three months.", "He explained how the {n} works and why it fails in hot weather.", "She teaches children how to draw a {n} with only five lines.", "Scientists measured the {n} again and found no change."]
_NOUNS = ["boat", "clock", "bridge", "violin", "melon", "lantern", "engine", "carpet", "kettle", "mask", "harp", "ladder"]
_TALK = ["In Python, f\"{name}\" puts the value of a variable into the string.", "What is {name} in an f-string? It is replaced by the value of the variable.", "The player must load the video and the page.", "Our teacher wrote {{ title }} on the board to show how template syntax works.", "A 404 page tells visitors that a link is broken, and this lesson shows how to design a friendly one.", "Lorem ipsum is based on a text by Cicero; printers have used it for centuries to show type.", "JavaScript was created in ten days, and today every browser runs it. We look at its history and its odd corners.", "In JavaScript, null and undefined are two different things.", "The null hypothesis says that both groups have the same mean.", "Division by zero gives NaN in floating point arithmetic, which is not equal to itself.", "She asked whether the page had loaded, and he said the server was having lunch.", "The waiter was sorry, the kitchen had closed, and we went home hungry.", "When the database went down we lost two hours of orders, so we built a second one.", "Use %s as a placeholder in the format string and pass the value as an argument.", "Set the variable $HOME before you run the script.", "We explain what the message 'please enable JavaScript' means and why sites show it.", "The shell expands ${USER} to your login name.", "Captchas ask people to prove that they are human; we test how well machines solve them.", "If the request times out, the client waits and tries again, which is called backoff.", "The template engine replaces {{ user }} with the name of the reader before the page is sent."]
_NOTES = ["[Music]\n[Applause]\nGood evening and welcome to the show.", "[laughter] I told you it would rain. [sighs]", ">> SPEAKER 1: We start with the dough.\n>> SPEAKER 2: [inaudible] and then the salt.", "[door creaks] Who is there? [footsteps]", "<i>Once upon a time</i> there was a <b>very</b> small house.", "<p>The soup is ready.</p>\n<p>Bring bread.</p>", "00:00:01.000 --> 00:00:04.000\n<v Anna>We are on the roof now.", "(laughs) That is not what I meant. (music playing)", "[upbeat music] Today we paint the fence green. [birds chirping]", "The price rose by 5% and then by 12% within a year.", "Cost: $5 for kids and $9 for adults.", "Use a < b and b > c, then a may be anything.", "He wrote in his diary [sic] that the sea was flat.", "My cat sits on the keyboard & types all day :)", "See note [3] and the table on page 40.", "JOHN: Did you hear that?\nMARY: [whispering] Hear what?", "Ingredients | Amount | Unit\nFlour | 200 | g", "snake_case_names and camelCaseNames are both fine.", "Score: 3-2 (after extra time)", "a + b = c, f(x) = 2x, {1, 2, 3} is a set"]


def residue() -> dict[str, list[str]]:
    """Texts of each kind that are cases."""
    real = ["The bread rises for an hour.", "We met at the old lighthouse.", "It was the coldest day of the year.", "Bring a friend and a good pair of boots.", "The orchestra tuned for a long time.", "Our garden is open to everyone in June.", "The second half is about glass and fire.", "He counted the sheep twice.", "They repaired the roof before winter.", "All proceeds go to the local school."]
    return {
        "placeholder": [f.replace("{}", s) for f, s in product(_FRAMES, _SLOTS)],
        "missing": [f"{r} {m}" for m, r in product(_MISSING, real)],
        "filler": _pages(_FILLER),
        "script": _pages(_SCRIPT),
        "error": _pages(_ERROR),
    }


def clean() -> dict[str, list[str]]:
    """Texts of each kind that are none."""
    plain = [f.replace("{n}", n) for f, n in product(_PLAIN, _NOUNS)]
    return {
        "plain": plain + [f"{a} {b}" for a, b in islice(zip(plain, plain[37:]), 80)],
        "talk": _TALK + [f"{p} {t}" for t, p in product(_TALK, plain[:90:10])],
        "notes": _NOTES + [f"{t}\n{p}" for t, p in product(_NOTES, plain[5:95:10])],
    }


def _pages(texts: list[str]) -> list[str]:
    """Each text as it is, twice, in capitals, over lines, and with another of its kind."""
    out = []
    for k, t in enumerate(texts):
        other = texts[(k + 7) % len(texts)]
        out += [t, f"{t}\n{t}", t.upper(), t.lower(), f"{t}\n\n{other}", f"{other} {t}", "  " + t + "\r\n", f"<p>{t}</p>", f"{t} {texts[(k + 3) % len(texts)]}", f"<div>{other}</div>\n<div>{t}</div>"]
    return out
