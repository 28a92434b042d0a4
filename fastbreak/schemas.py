"""Explicit schemas of the domain tables and of the landed JSON feeds, and the keys of tables that are merged."""

from __future__ import annotations

ACTIONS = (
    "game_id int, id int, parent_action_id int, team_id int, player_id int, type string, quarter int, quarter_time string, user_time string, "
    "end_quarter_seconds_remaining int, end_game_seconds_remaining double, parameters_made string, parameters_type string, parameters_points int, "
    "parameters_free_throw_number int, parameters_free_throws_awarded int, parameters_player_in int, parameters_player_out int, team_score int"
)
ROSTERS = "game_id int, team_id int, player_id int, firstname string, lastname string, team_name string, team_name_local string, game_year int"
SCHEDULE = "game_id int, game_year int, game_date date, gn int, game_type int, team1 int, team2 int, team_name_eng_1 string, team_name_eng_2 string, score_team1 int, score_team2 int"
TEAM_DICT = "game_year int, team_id_schedule int, team_id_rosters int"

#: One document per game, as landed.
PLAY_BY_PLAY = (
    "result struct<gameInfo:struct<gameId:int,"
    "homeTeam:struct<id:int,name:string,nameLocal:string,players:array<struct<id:int,firstName:string,lastName:string>>>,"
    "awayTeam:struct<id:int,name:string,nameLocal:string,players:array<struct<id:int,firstName:string,lastName:string>>>>,"
    "actions:array<struct<id:int,parentActionId:int,type:string,quarter:int,quarterTime:string,userTime:string,teamId:int,playerId:int,score:string,"
    "parameters:struct<made:string,type:string,points:int,playerIn:int,playerOut:int,freeThrowNumber:int,freeThrowsAwarded:int>>>>"
)
#: The schedule feed, as landed.
SCHEDULE_FEED = "games array<struct<ExternalID:string,game_date_txt:string,score_team1:int,score_team2:int,team1:int,team2:int,team_name_eng_1:string,team_name_eng_2:string,gn:int,game_type:int,season:string,competition:string>>"

KEYS = {
    "actions_clean": ["game_id", "team_id", "id"],
    "full_rosters": ["game_id", "team_id", "player_id"],
    "schedule": ["game_id"],
    "schedule_team_dict": ["game_year", "team_id_schedule"],
    "lineups_lookup_on": ["lineup_hash", "team_id", "player_id", "game_year"],
    "sub_lineups_stats": ["team_id", "sub_lineup_hash", "game_year"],
}
