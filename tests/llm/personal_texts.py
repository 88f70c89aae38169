"""Held-out lines for the tagger of personal information: written from general knowledge,
without looking at the test tables, before the training lines were widened."""

from __future__ import annotations

from itertools import product

_NAMES = ["Priya Raghunathan", "Tomasz Wisniewski", "Fatou Diallo", "Nguyen Van An", "Ingrid Bergström", "Kwame Mensah", "Dr. Okafor", "Prof. Helga Lindqvist", "Mateusz Kowalczyk", "Aoife Gallagher", "Hiroshi Tanaka", "Chidi Anagonye", "Mr. Papadopoulos", "Rosalind Franklin", "Sven-Erik Johansson", "María José Fernández", "Ludwig van Houten", "Wei Zhang", "Leila Haddad", "Mrs. Thistlewood", "Gareth B. Pritchard", "Siobhan O'Leary"]
_NAME_FRAMES = ["We interviewed {} at the studio last spring.", "This talk was given by my colleague {}.", "Script and voice: {}", "{} joined us for the second half of the show.", "Many thanks to {}, who fixed the lights.", "According to {}, the tower is older than the town.", "Cello: {}", "Hosted by {} in front of a live audience.", "A short film by {}", "We visited {} and looked at the old press."]
_PHONES = ["07700 900123", "+44 7700 900123", "(212) 555-0187", "212-555-0187", "+1 212 555 0187", "+33 1 23 45 67 89", "01 23 45 67 89", "+49 30 1234567", "030 1234567", "+91 98765 43210", "+34 612 345 678", "020 7946 0958", "555.867.5309", "+61 2 5550 1234", "+39 06 1234 5678", "1-800-555-0199", "+81 3-1234-5678", "(030) 123 45 67", "+31 20 123 4567", "0171 2345678"]
_PHONE_FRAMES = ["Call us on {}", "Phone: {}", "You can reach the workshop at {} on weekdays.", "Tel {}", "For tickets ring {} before Friday.", "Our number is {}.", "Text {} to join the list", "Mobile: {}", "Bookings {} or at the door", "WhatsApp: {}"]
_IDS = ["Her aadhaar is 1234 5678 9012", "Aadhaar no. 2345 6789 0123", "SSN: 123-45-6789", "My social security number is 078-05-1120", "Passport no. X1234567", "passport number 123456789", "National ID: 8001015009087", "driver's license D123-4567-8901", "Driving licence number MORGA657054SM9IJ", "NI number QQ 12 34 56 C", "National Insurance: AB123456C", "tax ID 12-3456789", "Steuer-ID 12 345 678 901", "DNI: 12345678Z", "CPF 123.456.789-09", "codice fiscale RSSMRA85T10A562S", "ID card number 123456789", "social insurance number 046 454 286", "PESEL 44051401359", "TIN: 912-34-5678"]
_ID_FRAMES = ["{}", "{}, please do not share it.", "The form says {}", "On the scan you can read {}", "Applicant data: {}", "{} (expired)", "They wrote down {} and let us in.", "Lost and found: {}", "We still need this: {}", "{} was on the envelope."]
_ADDRESSES = ["14 Rue de la Paix, 75002 Paris", "221B Baker Street, London", "Via Roma 12, 00184 Roma", "Lindenstraße 14, 10969 Berlin", "12 Oak Plaza", "5 Elm Crescent, Bristol", "77 Sunset Parkway, Springfield, IL 62704", "1600 Pennsylvania Avenue NW, Washington, DC 20500", "PO Box 1234, Leeds", "P.O. Box 77, Auckland 1140", "Calle Mayor 3, 28013 Madrid", "Keizersgracht 123, 1015 CJ Amsterdam", "Apt 4, 30 Mill Lane, Oxford", "350 Fifth Avenue, New York, NY 10118", "Avenida Central 45, Lisboa", "8 Harbour Road, Galway", "19 Church Hill, Bath BA1 5LA", "Bahnhofstrasse 21, 8001 Zürich", "Unit 6, 42 Station Road, Perth", "3 Place de la République, Lyon"]
_ADDRESS_FRAMES = ["Visit us at {}", "Address: {}", "Send letters to {}", "The studio is at {}, ring twice.", "We live at {}", "Parcels go to {} please", "Find the shop: {}", "Our new office, {}, opens in May.", "Meet at {} on Sunday", "Return address: {}"]
_EMAILS = ["jane.doe@gmail.com", "info@old-mill.co.uk", "k.smith+shop@example.org", "press@studio.example", "bob_99@mail.example.com", "CONTACT@EXAMPLE.COM", "anna (at) example (dot) com", "tom [at] mill [dot] org", "team@xn--brcke.example", "hello@north.film", "a.b.c@uni.example.edu", "sales@123box.net", "me@my-site.io", "o'hara@example.ie", "jobs@example.museum", "lee AT example DOT net", "x@y.org", "first-last@sub.domain.example", "user%test@example.com", "support@example.co.jp"]
_EMAIL_FRAMES = ["Write to {}", "Email: {}", "Questions? {}", "Contact {} for prints", "You can reach me at {} any time.", "{}", "Bookings via {} only", "(mail {})", "Say hello: {} !", "For scores ask {} please"]
_CLEAN = ["We walked from the harbour to the old lighthouse in two hours.", "Part 3 of 12: how to sharpen a kitchen knife", "Filmed on location in New Zealand and on the Isle of Skye.", "Music: \"Golden Morning\" by the Harbour Lights Orchestra", "Order number 2024-118-77 was shipped on 12 March 2024.", "Model KX-4500, serial 88231-B, firmware 2.1.4", "Subscribe for a new video every Tuesday and Friday!", "The recipe needs 250 g of flour, 2 eggs and 1 tsp of salt.", "Follow @oldmillfilms and visit https://www.oldmill.example/tour?id=48213", "Chapter 4 12:30 - 18:45 The Long Way Home", "Winner of the Golden Reel at the Lake District Film Festival", "Sponsored by Northwind Coffee Roasters and the City Library.", "Batch 4471, best before 2026-08-15", "How To Build A Wooden Boat In Ten Days", "Temperature rose from 18 to 31 degrees within 45 minutes.", "The match ended 3-2 after extra time in front of 41,000 people.", "All rights reserved. No part may be reused without consent.", "ISBN 978-3-16-148410-0, second edition", "Invoice 100245 over 1,250.00 EUR is due in 14 days.", "Recorded live at the Royal Albert Hall in London.", "They call it the Black Forest cake, and Monday Morning Club loves it.", "Version 10.0.19045 fixes the bug in build 22631.", "Coordinates: 51.5007 N, 0.1246 W", "Buy the Bosch GSR 12V drill or the Makita DF333D.", "In 1969 the rocket flew 384,400 km in 75 hours."]


def cases() -> list[tuple[str, str]]:
    """(kind, line): lines that hold personal information of that kind."""
    sets = (("person_name", _NAMES, _NAME_FRAMES), ("phone", _PHONES, _PHONE_FRAMES), ("id_number", _IDS, _ID_FRAMES), ("address", _ADDRESSES, _ADDRESS_FRAMES), ("email", _EMAILS, _EMAIL_FRAMES))
    return [(kind, f.replace("{}", x)) for kind, xs, fs in sets for x, f in product(xs, fs)]


def clean() -> list[str]:
    """Lines that hold none: each as it is, and with a second one, and in capitals."""
    return [x for k, t in enumerate(_CLEAN) for x in (t, f"{t} {_CLEAN[(k + 1) % len(_CLEAN)]}", f"- {t}", f"{_CLEAN[(k + 11) % len(_CLEAN)]} {t}", t.upper(), f"{t} {_CLEAN[(k + 5) % len(_CLEAN)]}", f"** {t} **", f">> {t}", f"{t}!")]
