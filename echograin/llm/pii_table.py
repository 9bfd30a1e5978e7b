"""The labelled table that the conditional random field learns from.

Each line is a text in which [kind:...] marks personal data. Lines without a mark teach
what isn't: dates, versions, prices, codes, tables, and numbers in the shape of a telephone's that an
order, a part or a case goes by.
"""

LINES = """
call me at [phone:(415) 555-0132] after six
tel [phone:415-555-0132] or the desk
tel. [phone:(020) 555-7713] , ask for the editor
her number is [phone:212-555-0187] and his is [phone:646-555-0110]
phone: [phone:(303) 555-0148] weekdays
reach us on [phone:303.555.0148] any day
fax [phone:617.555.0199] for forms
fax: [phone:(617) 555-0199] for forms
the office, [phone:(702) 555-0102], is shut
mobile [phone:702-555-0102] only
ring [phone:001-415-555-0132] from abroad
write to [email:jane.doe(at)mail.example.com] soon
write to [email:jane.doe[at]mail.example.com] soon
mail [email:sales[at]example[dot]org] for a quote
mail [email:sales(at)example(dot)org] for a quote
address [email:j_smith(at)uni.example.edu] is read daily
contact [email:info[at]example.net] please
contact [email:press(at)example(dot)net] please
card [card:4111.1111.1111.1111] was charged
card [card:5500.0000.0000.0004] was charged
paid by [card:3782.822463.10005] last week
number [card:6011/0009/9013/9424] on file
number [card:4111/1111/1111/1111] on file
paid by [card:4012_8888_8888_1881] today
host [ip:192[.]168[.]10[.]4] answered
blocked [ip:203[.]0[.]113[.]77] at noon
from [ip:198[.]51[.]100[.]23] it came
mail goes to a.b@example.com today
mail ann.34@mail7.example.com is base
call +1 (974) 555-3436 that day
call +44 20 7946 0958 at noon
server 10.0.0.1 is up
servers 192.168.1.10 and 192.168.1.11 are up
card 4111 1111 1111 1111 was used
card 4111111111111111 was used
on 2024-01-15 it began
on 15.01.2024 it began
on 01/15/2024 it began
from 1999 to 2004 it ran
license, version 2.0. applies
licensed under cc by-nc 4.0.
public license, version 3.
release 3.10.2 fixed it
release 1.2.3-4 fixed it
chapter 12.3.4 says so
it cost 1,299.00 in all
it cost $45.50 in all
at 12:30 and 18:45 daily
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was found
key 9233a8ecf7c5b09fe5949719b6b82bc439e9329b is secret
commit 7f3a9c1 broke it
isbn 978-3-16-148410-0 in print
isbn 9783161484100 in print
order 555-12 is late
room 415-B is free
lines 120-135 and 140-155
pages 12-19 , 33-40
flight 555-0132 is full
score 21-14 21-18
part (12) of (15)
see (1999) and (2004a)
table | 12 | 34 | 5678 |
table | 123456 | 98765 | 4321 |
serial 1234-5678 sold
zip 94103-1234 here
seat (12A) taken
call back (at) once (dot) dot
meet (at) noon
handle @someone wrote
handles @a and @b wrote
price @ 12 each
100000000000 stars
1000000 and 2000000
n = 6.02214076
x1 = 0.5, x2 = 0.25
ref 2021.12.31.7 filed
ref A-12-34-56 filed
ratio 3/4 and 7/8
path /usr/lib/python3.13/site
phone 12 was lost
tel 3 rings
card 7 of 52
number 415 in line
code 555-555 is open
id 12345-678-90123 is set
series 111.222.333.444 ended
please call [phone:312-555-0175] now
you can call [phone:(212) 555-0143] tonight
text [phone:646-555-0164] when you arrive
my phone is [phone:503-555-0127] until june
the phone number [phone:206.555.0191] works
contact [phone:404-555-0118] for tickets
dial [phone:(512) 555-0136] and wait
dial [phone:808-555-0152] then press two
our helpline [phone:(617) 555-0170] is free
cell [phone:213-555-0188] or home [phone:(213) 555-0189]
whatsapp [phone:305-555-0103] any time
his number: [phone:919-555-0146]
[phone:(206) 555-0111] is the desk
[phone:415.555.0122] rings twice
order 415-555-0132 shipped
order 212-555-0187 was late
your order 646-555-0110 is here
invoice 303-555-0148 is paid
invoice 702.555.0102 is open
tracking 617-555-0199 shows nothing
part 206-555-0191 is sold out
part no 312-555-0175 is sold out
case 503-555-0127 was closed
ticket 404-555-0118 was closed
serial 512-555-0136 is void
serial number 919-555-0146 is void
account 213-555-0188 is frozen
reference 305-555-0103 was quoted
item 808-555-0152 costs little
sku 646-555-0164 is in stock
product code 312.555.0175 changed
batch 404.555.0118 failed
mail [email:bob[at]corp.example.com] or wait
please email [email:mary(at)shop.example.org] today
send it to [email:team[at]lab.example.edu] by friday
ask [email:kim.lee(at)news.example.com] about it
[email:root[at]host.example.net] is watched
reach [email:desk[at]example[dot]com] first
at [ip:10[.]20[.]30[.]40] we saw it
seen from [ip:172[.]16[.]254[.]1] twice
address [ip:192(.)0(.)2(.)146] was banned
traffic to [ip:198(.)51(.)100(.)7] stopped
charge [card:4242/4242/4242/4242] please
visa [card:4012.8888.8888.1881] expired
use [card:5105_1051_0510_5100] next time
amex [card:3714.496353.98431] is fine
ring [phone:314-555-0190] or [phone:314-555-0191] then
call [phone:(314) 555-0192] or [phone:314.555.0193] first
my cell [phone:662-555-0104] rings
version 192[.]168[.]1 is old
step [1] and step [2] differ
note (a) on page 12 [b]
look (at) the [dot] here
sum 4111/1111 is odd
""".strip().split("\n")
