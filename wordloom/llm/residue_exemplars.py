"""Labelled exemplars of template residue, filler, error pages and notices.

Fixed values, in natural order: whole lines as people meet them on public sites and in
public server software, labelled by kind. Lines under SLOT and MISSING are read as shapes
(residue.slots): "[name]" stands for any such slot after the word before it.
"""

from __future__ import annotations

#: Slots that are unfilled wherever they stand: each opening and closing around each kind of
#: name; only the shape counts, not the name inside.
SURE = "{{ }} {{{ }}} { } ${ } #{ } {% %} <% %> %% %% @@ @@ ## ## *| |* $ $".split()
NAMES = ["name", "Name", "NAME", "user_name", "first name", "0"]
#: Brackets that other texts use too: unfilled with joined words, or with one of these words first.
LOOSE = "[ ] [[ ]] < > (( )) __ __ | | % %".split()
JOINED = "user_name"
FIRST = "insert your enter add type choose select replace fill write put".split()

#: Brackets that notes and markup use too: unfilled after a word that a value must follow ...
AFTER = "by from at with our your dear hi hello hey to in for on of welcome about meet join via visit see call contact the named called titled sincerely regards thank".split()
OPEN = "[name] [Name] [NAME] <name> <Name> <NAME> |name| |Name| |NAME| ((name)) ((Name)) ((NAME)) __name__ __Name__ __NAME__ %NAME%".split()
#: ... or with the name of a field inside, as the only or the last word.
FIELD = "address amount author brand channel city company country customer date day description duration email episode event guest host hour image item label language link location month name number person phone place price product publisher quantity reason speaker store street subject summary surname tag tags text time title topic total url user username venue video year".split()

#: Words that stand for one another in exemplars and texts alike.
SAME = {
    "javascript": "js script scripts scripting",
    "page": "pages site website webpage app application clip clips video videos channel playlist transcript transcripts caption captions subtitles file files account recording comment comments content player document article episode resource url post image item user album profile stream feed section",
    "view": "see read watch use load open show display access play run continue visit browse",
    "viewed": "seen shown displayed loaded opened played found located reached read processed completed fulfilled handled rendered",
    "loading": "reading fetching opening processing retrieving accessing rendering playing parsing",
    "enable": "activate allow permit",
    "enabled": "activated allowed permitted on",
    "disabled": "deactivated blocked off unsupported",
    "please": "kindly",
    "sorry": "oops whoops oh uh ooops apologies",
    "error": "errors failure failures problem problems fault",
    "removed": "deleted taken suspended terminated moved expired",
    "unavailable": "inaccessible unreachable offline private",
    "uploader": "owner author publisher creator",
    "try": "retry attempt",
    "later": "soon shortly",
    "reload": "refresh",
    "must": "should need have",
    "requires": "needs demands",
    "required": "needed necessary",
    "server": "service host backend",
    "country": "region location area territory",
    "something": "anything things",
    "administrator": "admin support webmaster owner",
    "a": "an",
    "isn": "aren wasn doesn don didn couldn can cannot won",
    "centre": "center",
    "log": "sign",
}

#: Missing values after or before a word.
MISSING = """
by undefined
by null
by nan
by none
hello undefined
hello null
hello none
hi undefined
hi null
hi none
hey undefined
hey null
dear undefined
dear null
dear none
welcome undefined
welcome null
back undefined
back null
: undefined
: null
: nan
$ nan
$ undefined
of undefined
of nan
from undefined
from null
in undefined
on undefined
on null
at undefined
to undefined
with undefined
with null
for undefined
only nan
about nan
nan minutes
nan seconds
nan hours
nan days
nan views
nan likes
nan comments
nan stars
nan of
nan percent
nan people
undefined minutes
undefined seconds
undefined hours
undefined views
undefined of
null minutes
null seconds
null views
null of
none minutes
rated none
"""

#: Words of talk about templates and code; a slot or missing value beside them is no residue.
CODE = "template templates templating placeholder placeholders variable variables syntax code python javascript sql string strings jinja mustache handlebars shell expands braces brackets regex compiler programming".split()
#: Sounds and remarks in brackets.
NOTES = "music applause laughter laughs chuckles sighs gasps sobs coughs cheers boos silence noise static bleep beep inaudible indiscernible unintelligible crosstalk foreign redacted sic pause whispers shouts screams cries sings claps knocks theme song sound sounds voice audio continues".split()
MARKUP = "abbr article aside body button cite code del div font footer head header html img input ins label main mark nav pre section small span strong style sub sup table tbody thead video".split()

PAGES: dict[str, str] = {
    "residue": """
todo write intro about
todo write this section
todo add text here
tbd to be written
tbd add description
your description goes here
your text here
your title goes here
""",
    "words": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores
vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
test testing tests one two three end of
blah bla
asdf asdfgh asdfasdf qwer qwerty zxcv zxcvb hjkl uiop jkl
foo bar baz qux
xxx xx xxxx xxxxx
text sample
dummy text copy
heading title text item caption subtitle paragraph
""",
    "filler": """
this is a test
this is only a test
this is placeholder copy replace before publishing
this is placeholder text do not publish
replace this text with your own
replace this text with your content
this is a sample text paragraph replace it
dummy paragraph for layout only
this is dummy text for the layout
your sample content text goes here
your text goes here your content here
your title goes here subtitle goes here
add your text here
add your own text here
add a description here
enter your text here enter text
type your text here
insert your text here
write something here
click here to edit this text
click to edit
double click to edit this paragraph
title goes here
description goes here
content coming soon
coming soon
under construction
page under construction
nothing to see here yet
no content yet
""",
    "script": """
please enable javascript to continue
please enable javascript to view this page
please enable javascript in your browser settings and reload the page
please enable javascript in your browser to use this site
please turn on javascript in your browser settings
kindly activate javascript to watch this video
please activate scripts to see the comments
please allow scripts to load the player and reload
you need to enable javascript to run this app
you must have javascript enabled to use this website
you have to allow scripts and cookies to load the comments
we are sorry but this app does not work properly without javascript enabled please enable it to continue
this page requires javascript please enable it and reload the page
this site requires javascript to work properly
this website requires javascript to be enabled
javascript is required to view this page
javascript is required for this app
javascript is disabled in your browser
javascript is turned off
javascript seems to be disabled in your browser
javascript is not enabled in your browser so this page cannot be shown
javascript must be enabled to view this site
scripts are disabled in your browser
scripting is turned off
client side scripting is blocked it is needed to load the page
we have detected that javascript is disabled in this browser please enable javascript or switch to a supported browser to continue
your browser does not support javascript
your browser does not currently support javascript or it is disabled
your browser has javascript turned off or disabled
your browser blocks javascript
we could not load the page because your browser blocks scripts
it looks like javascript is disabled
for full functionality of this site it is necessary to enable javascript
some features require javascript
here are the instructions how to enable javascript in your web browser
to use this site please enable javascript
to view this video please enable javascript and consider upgrading to a web browser that supports html video
without javascript you cannot see the page
without javascript you cannot view the page
without scripts and cookies the player cannot load
javascript is not supported here it is needed to view the page
noscript comments are shown only with javascript enabled
enable javascript and cookies to continue
cookies must be enabled to use this site
cookies and javascript must be allowed for the player to load
please turn on cookies and reload the page
please enable cookies
your browser is blocking cookies
your browser does not accept cookies
checking your browser before accessing the site
checking your browser before you continue this takes a few seconds
this process is automatic your browser will redirect to your requested content shortly
please allow up to seconds
checking if the site connection is secure
needs to review the security of your connection before proceeding
verify you are human by completing the action below
verify that you are human
verifying you are human this may take a few seconds
please confirm that you are not a robot
please verify that you are not a robot
prove that you are human
i am not a robot
just a moment
one more step
one moment please
please wait while your request is being verified
please complete the security check to access
please complete the captcha
why do i have to complete a captcha
completing the captcha proves you are a human and gives you temporary access to the web property
our systems have detected unusual traffic from your computer network
scripts are blocked so the check cannot start
performance and security by ray id
loading if nothing happens allow scripts and reload
this site requires javascript yours seems to be switched off
switch on client side scripting in your settings and reload
bitte aktivieren sie javascript um diese seite anzuzeigen
bitte aktivieren sie javascript in ihrem browser
bitte javascript aktivieren um fortzufahren
javascript ist in ihrem browser deaktiviert
diese seite benotigt javascript
diese website erfordert javascript
bitte bestatigen sie dass sie kein roboter sind
veuillez activer javascript pour afficher cette page les sous titres
veuillez activer javascript dans votre navigateur pour continuer
javascript est desactive dans votre navigateur
ce site necessite javascript
activa javascript en tu navegador para continuar
por favor active habilita javascript en su tu navegador para ver esta pagina
para continuar active habilite javascript
javascript esta desactivado en su tu navegador
este sitio requiere necesita javascript
per favore abilita attiva javascript nel tuo browser per continuare
per continuare abilita attiva javascript
per visualizzare questa pagina e necessario attivare abilitare javascript
javascript e disabilitato nel tuo browser
ative habilite o javascript no seu navegador para continuar ver esta pagina
o javascript esta desativado no seu navegador
schakel javascript in om deze pagina te bekijken
zet javascript aan in je browser
javascript is uitgeschakeld in uw browser
wlacz javascript w przegladarce aby wyswietlic te strone
aktivera javascript i din webblasare for att visa sidan
включите javascript в браузере чтобы просмотреть эту страницу
""",
    "error": """
error error code id
error code message
error while loading page
error loading video
error fetching the transcript
error reading the captions file
an error occurred
an error occurred while loading the page
an error has occurred please try again later
an error occurred please reload the page playback id
an unexpected error occurred
an unexpected error has occurred please contact the administrator
unexpected error contact support if the problem persists
an internal error occurred while processing your request
unknown error
fatal error uncaught exception in file player php on line
fatal error allowed memory size exhausted
parse error syntax error unexpected on line
warning cannot modify header information headers already sent
uncaught typeerror cannot read properties of undefined
traceback most recent call last file line in fetch module keyerror
traceback most recent call last file app py worker py line in module
exception in thread main java lang nullpointerexception
java io filenotfoundexception response not found for url
java lang illegalstateexception at org apache
java lang runtimeexception at com example main run main java
caused by connection refused
http error
http status not found
http error the server did not respond in time
bad request
bad request your browser sent a request that this server could not understand
unauthorized
unauthorized authentication required
forbidden
forbidden you don t have permission to access this resource on this server
forbidden access to this resource on the server is denied
access denied
access denied you do not have permission to view this page
access denied you don t have permission to access on this server reference
you are not authorized to view this page
not found
page not found
file not found
not found the page you asked for could not be found
not found the requested url was not found on this server
the requested resource could not be found
the requested page does not exist or was moved
we couldn t find that page
oops that page can t be found
oops something went wrong
it looks like nothing was found at this location maybe try a search
the page you are looking for does not exist
the page you are looking for might have been removed had its name changed or is temporarily unavailable
the page you requested was not found
sorry the page you requested could not be found
sorry we can t find that page
sorry no results
no results found
the link you followed may be broken or the page may have been removed
the address may be wrong check the address and try again
go back try a search instead
method not allowed
not acceptable
request timeout
request timed out
the request timed out the server took too long to respond
gone
gone the clip has moved
payload too large
too many requests
too many requests please try again later
too many requests slow down and retry in seconds
you have been rate limited
rate limit exceeded
quota exceeded
internal server error
internal server error the server encountered an unexpected condition that prevented it from fulfilling the request
the server encountered an internal error or misconfiguration and was unable to complete your request
internal server error the incident has been logged
more information about this error may be available in the server error log
not implemented
bad gateway
bad gateway the web server reported a bad gateway error
bad gateway upstream closed the connection
web server received an invalid response while acting as a gateway or proxy server
the proxy server received an invalid response from an upstream server
service unavailable
service temporarily unavailable
service unavailable in your region
no server is available to handle this request
the server is temporarily unable to service your request due to maintenance downtime or capacity problems please try again later
the service is temporarily unavailable please try again later
gateway timeout
gateway time out the server did not respond in time
web server is down
connection timed out
connection refused
connection reset
origin is unreachable
host error
the connection was reset
this site can t be reached
this page isn t working
the server unexpectedly closed the connection
unable to connect
secure connection failed
your connection is not private
error establishing a database connection
could not connect to the database
connection to database failed timeout after ms
sql error duplicate entry
stack overflow
null pointer
out of memory
read timed out at line
accessdenied
accessdenied request has expired
nosuchkey the specified key does not exist
accessdenied access denied requestid hostid
your session has expired
your session has expired please sign in again to continue
your session has timed out please log in again
please log in to continue
you must be logged in to view this page
invalid token
your request could not be processed reference number
we could not process your request
something went wrong
something went wrong please try again later
something went wrong on our side please try again later code
sorry something went wrong we are working on it and will get it fixed as soon as we can
we re sorry for the inconvenience
whoops looks like something went wrong
uh oh something is broken
please refresh the page and try again
please try again in a few minutes
please check back soon
come back later
if the problem persists contact the administrator
we are currently down for maintenance
the site is down for maintenance please come back soon
we are performing scheduled maintenance and will be back shortly
our site has run into a problem please refresh
we have run into a problem
we have been down for maintenance
we have no answer
our site has been down for maintenance reload later
our site has no answer
reload later
come back in a few minutes
our server has no answer come back soon
video unavailable
this video is unavailable
this video is not available
this video isn t available anymore
this video is private
this video has been removed by the user
this video was removed by the uploader
this clip has been removed by the owner
this video has been removed for violating the terms of service
this video is no longer available
this video is no longer available because the account associated with this video has been terminated
this account has been suspended
the uploader has not made this video available in your country
this content is not available in your country
this content isn t available in your region right now
this page isn t available the link you followed may be broken
this recording is private ask the owner for access
the recording you are looking for has expired
the transcript does not exist
the transcript was deleted
the playlist is no longer here
the page cannot be displayed
the file could not be loaded
sorry this clip failed to load
sorry this page was taken down
sorry this page is private
sorry this transcript has moved
this account cannot be shown
captions could not be loaded reload the player and try again
transcript not found
comments could not be loaded
sign in to confirm your age this video may be inappropriate for some users
your browser is out of date and cannot play this clip
your browser can t play this video
playback error
media could not be loaded either because the server or network failed or because the format is not supported
page introuvable erreur
page non trouvee la page demandee n existe pas
une erreur est survenue veuillez reessayer plus tard
erreur interne du serveur
acces refuse vous n avez pas l autorisation
cette video n est plus disponible
seite nicht gefunden
die seite wurde nicht gefunden
die angeforderte seite adresse existiert nicht
fehler
es ist ein fehler aufgetreten bitte versuchen sie es spater erneut
zugriff verweigert
dieses video ist nicht mehr verfugbar
pagina no encontrada
la pagina que buscas no existe
la pagina solicitada no se ha encontrado
se ha producido un error intentalo de nuevo mas tarde
acceso denegado
este video no esta disponible codigo de error
pagina non trovata
la pagina richiesta non e stata trovata
si e verificato un errore riprova piu tardi
accesso negato
questo video non e disponibile
pagina nao encontrada
a pagina que voce procura nao existe
ocorreu um erro tente novamente mais tarde
este video nao esta disponivel
pagina niet gevonden
er is een fout opgetreden probeer het later opnieuw
nie znaleziono strony
wystapil blad sprobuj ponownie pozniej
страница не найдена
произошла ошибка попробуйте позже
""",
    "frame": """
copyright

home videos about contact
home about blog contact
help centre terms privacy
help center terms of service privacy policy
menu search sign in
menu log in
skip to main content
skip to content
back to start page
back to home page
return to the home page
go to the homepage
all rights reserved
contact support if this keeps happening
error id
request id
go back
reload
retry
try again
learn more
""",
    "talk": """
in this video we explain what this message means and why sites show it
in this lesson i show how to design a friendly error page
the lesson explains how to enable javascript step by step
today we learn why browsers run scripts and how to write them
when the page had loaded he asked and she said
i got this error when i tried so i fixed it
we had a problem with the server and lost two hours
the player must load the video and the page
the message says that the page was not found
printers used dummy words such as lorem ipsum so that nobody would read the page
the error tells visitors that a link is broken
a margin of error of percent is fine
the waiter was sorry the kitchen had closed
""",
}


def lines(label: str) -> list[str]:
    return [x for x in PAGES[label].strip().split("\n") if x]
