"""Sentences written by hand, apart from the test documents: (text, [(type, span), ...]).

TUNING was looked at while rules were written; HELD_OUT was written before them and is measured. It was looked at once,
when a faster version lost a sentence that the first one had found.
"""

TUNING = [
    ("Author: Jane Doe", [("name", "Jane Doe")]),
    ("From: Jane Doe <jane.doe@example.com>", [("name", "Jane Doe"), ("email", "jane.doe@example.com")]),
    ("Dear Anna Schmidt, thanks for the files.", [("name", "Anna Schmidt")]),
    ("Please call Maria Lopez tomorrow.", [("name", "Maria Lopez")]),
    ("Ring 555-0199 after lunch.", [("phone", "555-0199")]),
    ("mail me at john dot doe at example dot com", [("email", "john dot doe at example dot com")]),
    ("You can write to pete<at>mail.example.net any time.", [("email", "pete<at>mail.example.net")]),
    ("Elena Nettlebane called about the winch.", [("name", "Elena Nettlebane")]),
    ("We met at noon; the dot on the map was wrong.", []),
    ("The North Harbor Authority said the buoys were moved.", []),
    ("Prof. Oskar Lindqvist wrote the annex.", [("name", "Oskar Lindqvist")]),
    ("Sehr geehrter Herr Brandt, anbei die Liste.", [("name", "Brandt")]),
    ("Verfasser: Jürgen Hoffmann", [("name", "Jürgen Hoffmann")]),
    ("Bonjour Camille Fournier, voici le rapport.", [("name", "Camille Fournier")]),
    ("Rédigé par Luc Moreau le 3 mai.", [("name", "Luc Moreau")]),
    ("12 cours Mirabeau est fermé.", [("address", "12 cours Mirabeau")]),
    ("NIR: 2840575123456 12", [("id_number", "2840575123456 12")]),
    ("Version 4.2.1 was released on 2024-03-05 12:30.", []),
    ("Kind regards,\nTom Becker", [("name", "Tom Becker")]),
    ("负责人：王小明，电话 13812345678。", [("name", "王小明"), ("phone", "13812345678")]),
    ("The Data Loader reported 12 errors.", []),
    ("Deep Learning said nothing new.", []),
    ("Ask Priya Raman or Tobias Klein.", [("name", "Priya Raman"), ("name", "Tobias Klein")]),
]

HELD_OUT = [
    ("Written by Margaret O'Neill for the board.", [("name", "Margaret O'Neill")]),
    ("Hi Sandra, can you resend it?", [("name", "Sandra")]),
    ("To: Ravi Patel\nSubject: cable", [("name", "Ravi Patel")]),
    ("Dr. Helen Cho will join us on Monday.", [("name", "Helen Cho")]),
    ("Yesterday Thomas Weaver said the crane is fixed.", [("name", "Thomas Weaver")]),
    ("I spoke to Ingrid Solberg about the survey.", [("name", "Ingrid Solberg")]),
    ("Owner: B. Kowalski", [("name", "B. Kowalski")]),
    ("Best wishes,\nFiona McAllister", [("name", "Fiona McAllister")]),
    ("Prepared by: Samuel Ortiz", [("name", "Samuel Ortiz")]),
    ("Mrs. Adeyemi replied within the hour.", [("name", "Adeyemi")]),
    ("Captain Rourke wrote that the log is complete.", [("name", "Rourke")]),
    ("Name: Li Wei", [("name", "Li Wei")]),
    ("Thanks to Chloe Bennett for the photos.", [("name", "Chloe Bennett")]),
    ("Liebe Frau Vogel, danke für die Karte.", [("name", "Vogel")]),
    ("Hallo Stefan Krüger, wann kommt das Boot?", [("name", "Stefan Krüger")]),
    ("Erstellt von Petra Neumann am Montag.", [("name", "Petra Neumann")]),
    ("Ulrich Weber sagte, die Boje sei weg.", [("name", "Ulrich Weber")]),
    ("Bearbeiter: Dieter Schulz", [("name", "Dieter Schulz")]),
    ("Cher Monsieur Lambert, merci.", [("name", "Lambert")]),
    ("Validé par Sophie Garnier.", [("name", "Sophie Garnier")]),
    ("Auteur : Antoine Lefèvre", [("name", "Antoine Lefèvre")]),
    ("Mme Rousseau a confirmé la date.", [("name", "Rousseau")]),
    ("联系人：陈丽华", [("name", "陈丽华")]),
    ("请联系刘洋确认时间。", [("name", "刘洋")]),
    ("由赵国强负责维护。", [("name", "赵国强")]),
    ("Write to k.tanaka@lab.example.org for access.", [("email", "k.tanaka@lab.example.org")]),
    ("reach me: maria [at] example [dot] org", [("email", "maria [at] example [dot] org")]),
    ("contact bob_k at example dot co dot uk today", [("email", "bob_k at example dot co dot uk")]),
    ("Send it to ops+night@harbour-tools.io.", [("email", "ops+night@harbour-tools.io")]),
    ("Call +44 20 7946 0958 before five.", [("phone", "+44 20 7946 0958")]),
    ("Tel: (212) 555-0142", [("phone", "(212) 555-0142")]),
    ("My cell is 415-555-0134.", [("phone", "415-555-0134")]),
    ("Telefon 030/1234567, werktags.", [("phone", "030/1234567")]),
    ("Téléphone : 01 42 68 53 00", [("phone", "01 42 68 53 00")]),
    ("手机：139 1234 5678", [("phone", "139 1234 5678")]),
    ("Dial 020 7946 0321 for the desk.", [("phone", "020 7946 0321")]),
    ("SSN: 123-45-6789", [("id_number", "123-45-6789")]),
    ("Passport no. X1234567 expires soon.", [("id_number", "X1234567")]),
    ("Steuer-ID 12 345 678 901", [("id_number", "12 345 678 901")]),
    ("身份证号：11010519491231002X", [("id_number", "11010519491231002X")]),
    ("National Insurance number QQ 12 34 56 C", [("id_number", "QQ 12 34 56 C")]),
    ("She lives at 221b Baker Street in London.", [("address", "221b Baker Street")]),
    ("Ship to 1600 Pennsylvania Avenue, Suite 12.", [("address", "1600 Pennsylvania Avenue, Suite 12")]),
    ("Er wohnt in der Lindenallee 14.", [("address", "Lindenallee 14")]),
    ("Rendez-vous au 8 rue des Lilas.", [("address", "8 rue des Lilas")]),
    ("地址：人民路25号3单元", [("address", "人民路25号3单元")]),
    ("The Blue Whale dataset has 400 images.", []),
    ("Error 404 at line 5123456 in Module Loader.", []),
    ("Table 3 by Region shows the North Sea.", []),
    ("See Section Four of the Harbor Manual.", []),
    ("Release 2024.11.05 fixes Issue 1234567.", []),
    ("Model Alpha was trained with Batch Size 64.", []),
    ("The Baltic Sea has been mapped since 1998.", []),
    ("Das Rote Boot hat einen Motor.", []),
    ("La Mer du Nord a un fond plat.", []),
    ("样本编号 20240115 已处理。", []),
]
