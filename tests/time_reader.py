"""An independent row-at-a-time reader of time strings, on Python's own zone data; for tests only."""

import re,datetime as dt,unicodedata
from zoneinfo import ZoneInfo
M={m:i+1 for i,m in enumerate('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split())}
UTC=dt.timezone.utc
def at(y,mo,d,h,mi,s,tz):
    n=dt.datetime(y,mo,d,h,mi,s)
    return int(n.replace(tzinfo=ZoneInfo(tz),fold=0).timestamp())
def abbr(y,mo,d,h,mi,s,tz,ab):
    n=dt.datetime(y,mo,d,h,mi,s); z=ZoneInfo(tz)
    if ab in('UTC','GMT') : return int(n.replace(tzinfo=UTC).timestamp())
    for mm in (1,7):
        t=dt.datetime(y,mm,1,tzinfo=z)
        if t.tzname()==ab: return int((n-t.utcoffset()).replace(tzinfo=UTC).timestamp())
    raise ValueError(ab)
def ref(v,tz,cr):
    if v is None: return None
    std=re.fullmatch(r'\d{4}-\d\d-\d\d \d\d:\d\d:\d\d',v,re.A) and tz in(None,'Asia/Shanghai')
    tz=tz or 'Asia/Shanghai'
    t=unicodedata.normalize('NFKC',v).replace('\ufeff','').strip()
    crl=cr.astimezone(ZoneInfo(tz))
    try:
        u=None
        if re.fullmatch(r'\d{10}',t): u=int(t)
        elif re.fullmatch(r'\d{13}',t): u=int(t)//1000
        elif re.fullmatch(r'\d{16}',t): u=int(t)//1000000
        elif m:=re.fullmatch(r'(\d+) ?(分钟|小时)前',t): u=int(cr.timestamp()//1)-int(m[1])*(60 if m[2]=='分钟' else 3600)
        elif m:=re.fullmatch(r'(今天|昨天) (\d+):(\d+)',t):
            d=crl.date()-dt.timedelta(days=m[1]=='昨天'); u=at(d.year,d.month,d.day,int(m[2]),int(m[3]),0,tz)
        elif m:=re.fullmatch(r'(\d+)月(\d+)日 (\d+):(\d+)',t): u=at(crl.year,*map(int,m.groups()),0,tz)
        elif m:=re.fullmatch(r'(\d+)年(\d+)月(\d+)日 ?(上午|下午)?(\d+)[:时時](\d+)[分]?(\d+)?秒?',t):
            h=int(m[5]); h=h%12+12*(m[4]=='下午') if m[4] else h
            u=at(int(m[1]),int(m[2]),int(m[3]),h,int(m[6]),int(m[7] or 0),tz)
        elif m:=re.fullmatch(r'\d+-(\d+)年(\d+)-(\d+) (\d+):(\d+):(\d+)',t): u=at(*map(int,m.groups()),tz)
        elif m:=re.fullmatch(r'(\d+)\.(\d+)\.(\d+),? (\d+):(\d+)(?::(\d+))?( Uhr)?',t): u=at(int(m[3]),int(m[2]),int(m[1]),int(m[4]),int(m[5]),int(m[6] or 0),tz)
        elif m:=re.fullmatch(r'([A-Z][a-z]{2}) (\d+), (\d+),? (\d+):(\d+)(?::(\d+))? (AM|PM)',t): u=at(int(m[3]),M[m[1]],int(m[2]),int(m[4])%12+12*(m[7]=='PM'),int(m[5]),int(m[6] or 0),tz)
        else:
            if m:=re.fullmatch(r'[A-Z][a-z]{2} ([A-Z][a-z]{2}) (\d+) (\d+):(\d+):(\d+) (\S+) (\d+)',t): g=(int(m[7]),M[m[1]],int(m[2]),int(m[3]),int(m[4]),int(m[5])); z=m[6]
            elif m:=re.fullmatch(r'(?:[A-Z][a-z]{2},? )?(\d+) ([A-Z][a-z]{2}) (\d+),? (\d+):(\d+)(?::(\d+))?(?: (\S+))?',t): g=(int(m[3]),M[m[2]],int(m[1]),int(m[4]),int(m[5]),int(m[6] or 0)); z=m[7]
            elif m:=re.fullmatch(r'(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(\S+)',t): g=tuple(map(int,m.groups()[:6])); z=m[7]
            elif m:=re.fullmatch(r'(\d+)[-/](\d+)[-/](\d+)[T ](\d+):(\d+)(?::(\d+)(?:\.\d+)?)? ?(\S+)?',t): g=tuple(int(x or 0) for x in m.groups()[:6]); z=m[7]
            else: return None
            if not z: u=at(*g,tz)
            elif z=='Z': u=int(dt.datetime(*g,tzinfo=UTC).timestamp())
            elif m:=re.fullmatch(r'([+-])(\d\d):?(\d\d)',z): u=int(dt.datetime(*g,tzinfo=UTC).timestamp())-(1 if m[1]=='+' else -1)*(int(m[2])*3600+int(m[3])*60)
            elif '/' in z: u=at(*g,z.strip('[]'))
            else: u=abbr(*g,tz,z)
        return None if std else u
    except ValueError: return None
